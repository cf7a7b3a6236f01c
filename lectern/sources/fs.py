"""Files and folders through Spark's own file systems, and packages unpacked without leaving their folder."""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile

from pyspark.sql import SparkSession


class Files:
    """Reads, writes and lists wherever Spark can; paths are Hadoop's."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, path: str) -> list[str]:
        fs, p = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def drop(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        """Bytes of a file, or of all files in a folder; 0 where there is none."""
        fs, p = self.at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def stat(self, path: str) -> dict:
        fs, p = self.at(path)
        s = fs.getFileStatus(p)
        return {"length": s.getLen(), "folder": s.isDirectory(), "modified": s.getModificationTime()}

    def read(self, path: str) -> bytes:
        fs, p = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> bool:
        """A new file, whole or not at all; False if there is one already."""
        fs, p = self.at(path)
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(fresh, False)
        out.write(bytearray(data))
        out.close()
        if fs.exists(p) or not fs.rename(fresh, p):
            fs.delete(fresh, False)
            return False
        return True

    def write(self, path: str, data: bytes) -> None:
        """A file that readers see as it was or as it will be: written beside, then moved into its place."""
        fresh = f"{path}.{uuid.uuid4().hex}.tmp"
        self.create(fresh, data)
        fs, p = self.at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(options, 0, rename.OVERWRITE)
        context.rename(fs.makeQualified(self.at(fresh)[1]), fs.makeQualified(p), options)

    def copy(self, source: str, target: str) -> None:
        self.write(target, self.read(source))

    def unzip(self, data: bytes, target: str, most: int = 512 << 20) -> list[str]:
        """Unpacks a zip package; an entry that would land outside the target, or a package larger than ``most``, is an error."""
        out = []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            inside = [e for e in z.infolist() if not e.is_dir()]
            if sum(e.file_size for e in inside) > most:
                raise ValueError("the package is too large")
            for e in inside:
                safe_name(e.filename)
            for e in inside:
                self.write(f"{target}/{safe_name(e.filename)}", z.read(e))
                out.append(safe_name(e.filename))
        return out


def safe_name(name: str) -> str:
    """A package entry's path inside its folder; raises ValueError where it points out of it."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    if clean.startswith(("/", "../")) or clean in ("..", ".") or ":" in clean.split("/")[0]:
        raise ValueError(f"{name!r} leads out of its folder")
    return clean
