"""A store of question banks: immutable versions, an index, and one pointer that says which of them count.

Layout under the store's folder:

* ``data/__version=<version>/`` has the rows of the banks that one save replaced (Parquet; a folder
  per bank, named by a digest, so any string is a bank's id),
* ``index/<version>/`` has one row per bank: id, version of its rows, name, source, times, types,
* ``history/<version>/`` has what edited rows were, and marks of edits that were undone,
* ``pointer/<number>.json`` names an index, the versions it refers to and the histories; the highest
  number counts.

A write makes new folders, checks them, and then creates the next pointer, which fails if another
writer has made it.  Until that moment nothing has changed for any reader, and a write that fails
or loses leaves the store as it was; :meth:`Store.vacuum` removes what no pointer needs.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources import archive
from lectern.sources.fs import Files

INDEX = "bank_id string, version string, name string, source_name string, created_at long, updated_at long, types array<string>"
_OWN = ("__version", "__folder")


class Conflict(RuntimeError):
    """Another writer changed the store in the meantime; read again and repeat."""


def write_json(spark: SparkSession, path: str, value) -> None:
    """A JSON file that readers see as it was or as it will be."""
    Files(spark).write(path, json.dumps(value, ensure_ascii=False, sort_keys=True).encode())


def read_json(spark: SparkSession, path: str):
    return json.loads(Files(spark).read(path))


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    # what counts ------------------------------------------------------------------------------------
    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names(f"{self.path}/pointer") if n.endswith(".json"))

    def _pointer(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if number is None and not numbers:
            return {"number": 0, "index": None, "versions": [], "history": [], "schema": None}
        return json.loads(self.files.read(f"{self.path}/pointer/{number if number is not None else numbers[-1]:010d}.json"))

    def _switch(self, now: dict, **changes) -> None:
        after = now | changes | {"number": now["number"] + 1}
        if not self.files.create(f"{self.path}/pointer/{after['number']:010d}.json", json.dumps(after, sort_keys=True).encode()):
            raise Conflict(f"version {after['number']} of {self.path} was written by another")

    def index(self, number: int | None = None) -> DataFrame:
        """One row per bank, see :data:`INDEX`."""
        p = self._pointer(number)
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index/{p['index']}") if p["index"] else self.spark.createDataFrame([], INDEX)

    def load(self, bank_id: str | None = None) -> DataFrame:
        """All rows that count, or one bank's."""
        p = self._pointer()
        if not p["versions"]:
            raise FileNotFoundError(f"{self.path} has no banks")
        return self._rows(p, self.index(), bank_id)

    def _rows(self, p: dict, index: DataFrame, bank_id: str | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(p["schema"]))
        read = self._read(StructType.fromJson(schema.jsonValue()).add("__version", "string"), p["versions"])
        if bank_id is not None:
            read, index = read.filter(F.col("bank_id") == bank_id), index.filter(F.col("bank_id") == bank_id)
        own = index.select("bank_id", F.col("version").alias("__version"))
        return read.join(own, ["bank_id", "__version"], "left_semi").select(schema.names)

    def _folder(self, version: str) -> str:
        return f"{self.path}/data/__version={version}"

    def _read(self, schema, versions: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*map(self._folder, versions))

    # writes -----------------------------------------------------------------------------------------
    def _write(self, questions: DataFrame) -> tuple[str, int]:
        """(version, rows) of rows written and checked; nothing counts them yet."""
        version = "v" + uuid.uuid4().hex
        folder = F.concat(F.lit("b"), F.substring(F.sha2(F.col("bank_id").cast("binary"), 256), 1, 32))
        rows = questions.withColumn("bank_id", F.col("bank_id").cast("string"))
        rows.withColumn("__folder", folder).write.partitionBy("__folder").parquet(self._folder(version))
        written = self._read(rows.schema, [version])
        bad = written.groupBy("bank_id").agg(F.count("*").alias("n"), F.countDistinct("question_id").alias("d")).filter("bank_id IS NULL OR n <> d")
        if bad.limit(1).count():
            self.files.drop(self._folder(version))
            raise ValueError("a question lacks its bank or repeats an id")
        return version, written.count()

    def _commit(self, now: dict, questions: DataFrame, at: int, history: list[str], names: DataFrame | None = None) -> int:
        version, rows = self._write(questions)
        try:
            made = self._read("bank_id string", [version]).select("bank_id").distinct()
            old = self.index() if now["index"] else self.spark.createDataFrame([], INDEX)
            before = made.join(old.drop("version"), "bank_id", "left")
            if names is not None:
                given = names.select(F.col("bank_id").cast("string"), *(F.col(c).alias(f"__{c}") if c in names.columns else F.lit(None).cast("string").alias(f"__{c}") for c in ("name", "source_name")))
                before = before.join(given, "bank_id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in ("name", "source_name")}).drop("__name", "__source_name")
            fresh = before.withColumns({"version": F.lit(version), "name": F.coalesce("name", "bank_id"), "created_at": F.coalesce("created_at", F.lit(at).cast("long")), "updated_at": F.lit(at).cast("long")})
            index = old.join(made, "bank_id", "left_anti").unionByName(fresh.select(old.columns))
            schema = now["schema"]
            if schema is None or json.loads(schema) != questions.schema.jsonValue():
                schema = json.dumps(self._widened(schema, questions.schema).jsonValue())
            self._point(now, index, [*now["versions"], version], history, schema)
        except Exception:
            self.files.drop(self._folder(version))
            raise
        return rows

    @staticmethod
    def _widened(schema: str | None, other: StructType) -> StructType:
        """Both schemas' columns; ``bank_id`` is a string."""
        out = StructType.fromJson(json.loads(schema)) if schema else StructType()
        for f in other.fields:
            if f.name not in out.names:
                out.add(f.name, "string" if f.name == "bank_id" else f.dataType)
        return out

    def _point(self, now: dict, index: DataFrame, versions: list[str], history: list[str], schema: str | None) -> None:
        """A new index, and the pointer to it with those versions that it refers to."""
        name = uuid.uuid4().hex
        index.write.parquet(f"{self.path}/index/{name}")
        live = {r["version"] for r in self.spark.read.schema(INDEX).parquet(f"{self.path}/index/{name}").select("version").distinct().collect()}  # one a save
        try:
            self._switch(now, index=name, versions=[v for v in versions if v in live], history=history, schema=schema)
        except Conflict:
            self.files.drop(f"{self.path}/index/{name}")
            raise

    def save(self, questions: DataFrame, at: int = 0, names: DataFrame | None = None) -> int:
        """Replaces the banks that ``questions`` (with bank_id) holds; returns the rows written.

        ``names`` may give (bank_id, name, source_name).
        """
        now = self._pointer()
        return self._commit(now, questions, at, now["history"], names)

    def update(self, edits: DataFrame, at: int) -> None:
        """Replaces rows by (bank_id, question_id) and keeps what they were."""
        now = self._pointer()
        all_rows = self._rows(now, self.index())
        keys = edits.select("bank_id", "question_id").distinct()
        banks = all_rows.join(keys.select("bank_id").distinct(), "bank_id", "left_semi")
        image = uuid.uuid4().hex
        old = banks.join(keys, ["bank_id", "question_id"], "left_semi")
        old.withColumns({"saved_at": F.lit(at).cast("long"), "undone": F.lit(False), "seq": F.lit(now["number"]).cast("long")}).write.parquet(f"{self.path}/history/{image}")
        try:
            self._commit(now, banks.join(keys, ["bank_id", "question_id"], "left_anti").unionByName(edits.select(banks.columns)), at, [*now["history"], image])
        except Exception:
            self.files.drop(f"{self.path}/history/{image}")
            raise

    def history(self) -> DataFrame | None:
        """What edited rows were: the latest image of each that has not been taken back since."""
        p = self._pointer()
        if not p["history"]:
            return None
        schema = StructType.fromJson(json.loads(p["schema"])).add("saved_at", "long").add("undone", "boolean").add("seq", "long")
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/history/{h}" for h in p["history"]))
        last = rows.groupBy("bank_id", "question_id").agg(F.max("seq").alias("seq"))
        return rows.join(last, ["bank_id", "question_id", "seq"]).filter("NOT undone")

    def _images(self, bank_id: str, question_id: str) -> DataFrame | None:
        rows = self.history()
        return None if rows is None else rows.filter((F.col("bank_id") == bank_id) & (F.col("question_id") == question_id))

    def can_undo(self, bank_id: str, question_id: str) -> bool:
        rows = self._images(bank_id, question_id)
        return rows is not None and rows.limit(1).count() > 0

    def _mark(self, rows: DataFrame, now: dict) -> str:
        name = uuid.uuid4().hex
        rows.withColumns({"undone": F.lit(True), "seq": F.lit(now["number"]).cast("long")}).write.parquet(f"{self.path}/history/{name}")
        return name

    def undo(self, bank_id: str, question_id: str, at: int = 0) -> bool:
        """Puts back the latest image of a question, once."""
        if not self.can_undo(bank_id, question_id):
            return False
        now, image = self._pointer(), self._images(bank_id, question_id)
        mark = self._mark(image, now)
        rest = self.load(bank_id).filter(F.col("question_id") != question_id)
        try:
            self._commit(now, rest.unionByName(image.select(rest.columns)), at, [*now["history"], mark])
        except Exception:
            self.files.drop(f"{self.path}/history/{mark}")
            raise
        return True

    def clear_undo(self, bank_id: str, question_id: str) -> None:
        """Forgets what a question was."""
        if self.can_undo(bank_id, question_id):
            now = self._pointer()
            self._switch(now, history=[*now["history"], self._mark(self._images(bank_id, question_id), now)])

    def retype(self, bank_id: str, old: str, new: str, at: int = 0) -> None:
        """Renames a type of one bank; a row without a label goes by its core type's."""
        rows = self.load(bank_id)
        self.save(rows.withColumn("display_label", F.when(F.coalesce(F.col("display_label"), F.lit("")) == old, new).otherwise(F.col("display_label"))), at)

    def delete(self, bank_id: str) -> None:
        """The bank no longer counts, whatever its id looks like; vacuum frees its files."""
        now = self._pointer()
        self._point(now, self.index().filter(F.col("bank_id") != bank_id), now["versions"], now["history"], now["schema"])

    # the index --------------------------------------------------------------------------------------
    def banks(self) -> DataFrame:
        """Banks with their counts, newest first by ``place``."""
        from lectern.operators.sequence import numbered
        from lectern.operators.statistics import manifest

        rows = self.load()
        for c, kind in (("placeholder", "boolean"), ("status", "string")):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
        counts = manifest(rows.withColumns({"placeholder": F.coalesce("placeholder", F.lit(False)), "status": F.coalesce("status", F.lit("normal"))}))
        return numbered(self.index().drop("version").join(counts, "bank_id", "left"), [], [F.desc("updated_at"), F.asc("bank_id")], "place", F.lit(0))

    def rename(self, bank_id: str, name: str, at: int = 0) -> None:
        """A blank name keeps the old one."""
        given = F.nullif(F.trim(F.lit(name)), F.lit(""))
        now, own = self._pointer(), F.col("bank_id") == bank_id
        index = self.index().withColumns({"name": F.when(own, F.coalesce(given, "name")).otherwise(F.col("name")), "updated_at": F.when(own & given.isNotNull(), F.lit(at).cast("long")).otherwise(F.col("updated_at"))})
        self._point(now, index, now["versions"], now["history"], now["schema"])

    def save_types(self, bank_id: str, types: list[str]) -> None:
        """The bank's own catalogue of type labels."""
        now = self._pointer()
        index = self.index().withColumn("types", F.when(F.col("bank_id") == bank_id, F.array(*map(F.lit, types)) if types else F.expr("cast(array() as array<string>)")).otherwise(F.col("types")))
        self._point(now, index, now["versions"], now["history"], now["schema"])

    def types(self) -> DataFrame:
        """(bank_id, label): the saved catalogue and all labels in use, each once."""
        saved = self.index().select("bank_id", F.explode("types").alias("label"))
        used = self.load().filter("display_label <> ''").select("bank_id", F.col("display_label").alias("label"))
        return saved.unionByName(used).distinct()

    def snapshot(self) -> int:
        """The number of the state that counts now, for :meth:`rollback`."""
        return self._pointer()["number"]

    def rollback(self, number: int) -> None:
        """A former state counts again, as a new one; it must not have been vacuumed."""
        now, then = self._pointer(), self._pointer(number)
        self._switch(now, **{k: then[k] for k in ("index", "versions", "history", "schema")})

    def rebuild(self, at: int = 0) -> int:
        """A new index from the data that can be read: the newest version of each bank; returns the banks found."""
        found = []
        for version in (n.split("=", 1)[1] for n in self.files.names(f"{self.path}/data")):
            try:
                rows = self._read("bank_id string", [version])
                when = self.files.stat(self._folder(version))["modified"]
                if rows.limit(1).count():
                    found.append((version, when, rows.select("bank_id").distinct().withColumns({"version": F.lit(version), "when": F.lit(when)})))
            except PySparkException:  # a folder that no reader can read holds no bank
                continue
        if not found:
            return 0
        newest = reduce(DataFrame.unionByName, (f[2] for f in found)).groupBy("bank_id").agg(F.max_by("version", F.struct("when", "version")).alias("version"))
        now = self._pointer()
        known = self.index().drop("version") if now["index"] else self.spark.createDataFrame([], INDEX).drop("version")
        index = newest.join(known, "bank_id", "left").withColumns({"name": F.coalesce("name", "bank_id"), "created_at": F.coalesce("created_at", F.lit(at).cast("long")), "updated_at": F.coalesce("updated_at", F.lit(at).cast("long"))})
        schema = now["schema"] or json.dumps(StructType([f for f in self.spark.read.option("basePath", f"{self.path}/data").parquet(self._folder(found[-1][0])).schema.fields if f.name not in _OWN]).jsonValue())
        self._point(now, index.select([c.split()[0] for c in INDEX.split(", ")]), [f[0] for f in found], now["history"], schema)
        return self.index().count()

    # archives and cleaning --------------------------------------------------------------------------
    def export(self, bank_id: str) -> bytes:
        """One bank as an archive; a bank is a document's size, not a corpus's."""
        rows = [r.asDict(recursive=True) for r in self.load(bank_id).orderBy("question_id").collect()]
        return archive.pack({"kind": "bank", "bank_id": bank_id, "count": len(rows), "schema": self.load().schema.jsonValue()}, {"questions.json": json.dumps(rows, ensure_ascii=False).encode()})

    def restore(self, data: bytes, at: int = 0) -> int:
        """Checks the whole archive before anything is replaced."""
        meta, entries = archive.unpack(data)
        rows = json.loads(entries["questions.json"])
        if meta.get("kind") != "bank" or len(rows) != meta["count"] or any(r["bank_id"] != meta["bank_id"] for r in rows):
            raise ValueError("the archive doesn't hold what it says")
        return self.save(self.spark.createDataFrame(rows, StructType.fromJson(meta["schema"])), at)

    def orphans(self, records: DataFrame) -> DataFrame:
        """Records without a question."""
        return records.join(self.load().select("bank_id", "question_id"), ["bank_id", "question_id"], "left_anti")

    def _unneeded(self) -> list[str]:
        p = self._pointer()
        keep = {"data": {f"__version={v}" for v in p["versions"]}, "index": {p["index"]}, "history": set(p["history"]), "pointer": {f"{p['number']:010d}.json"}}
        return [f"{self.path}/{kind}/{name}" for kind, names in keep.items() for name in self.files.names(f"{self.path}/{kind}") if name not in names]

    def reclaimable(self) -> int:
        """Bytes that :meth:`vacuum` would free."""
        return sum(map(self.files.size, self._unneeded()))

    def vacuum(self) -> int:
        """Deletes what the present state does not need, former states included; returns the bytes freed."""
        freed = 0
        for path in self._unneeded():
            freed += self.files.size(path)
            self.files.drop(path)
        return freed
