"""Archives: one file with a magic word, JSON metadata and named entries.

Layout: the magic, the length of the metadata (unsigned 32 bits, little endian), the metadata, the
number of entries, then for each entry the lengths of its name and its bytes, the name, the bytes.
"""

from __future__ import annotations

import base64
import json
import struct

MAGIC = b"LECTERN1"


def pack(meta: dict, entries: dict[str, bytes]) -> bytes:
    head = json.dumps(meta, ensure_ascii=False, sort_keys=True).encode()
    parts = [MAGIC, struct.pack("<I", len(head)), head, struct.pack("<I", len(entries))]
    for name, data in sorted(entries.items()):
        raw = name.encode()
        parts += [struct.pack("<II", len(raw), len(data)), raw, data]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[dict, dict[str, bytes]]:
    """Raises ValueError for anything that isn't a whole archive."""
    try:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not an archive")
        at = len(MAGIC)
        (n,) = struct.unpack_from("<I", data, at)
        meta = json.loads(data[at + 4 : at + 4 + n].decode())
        at += 4 + n
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        entries = {}
        for _ in range(count):
            names, size = struct.unpack_from("<II", data, at)
            at += 8
            name, body = data[at : at + names].decode(), data[at + names : at + names + size]
            if len(body) != size:
                raise ValueError("truncated archive")
            entries[name] = body
            at += names + size
    except (struct.error, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError("damaged archive") from e
    if at != len(data):
        raise ValueError("bytes after the archive's end")
    return meta, entries


def banks(data: bytes) -> list[dict]:
    """Banks (name, questions, assets) of a package, or of a JSON file with ``questions``, or with ``banks`` as a
    full backup has; assets there are in Base64.  Raises ValueError for anything else."""
    if data[: len(MAGIC)] == MAGIC:
        meta, entries = unpack(data)
        if "questions.json" not in entries:
            raise ValueError("the archive holds no questions")
        return [{"name": meta.get("name") or meta.get("bank_id") or "", "questions": json.loads(entries.pop("questions.json")), "assets": entries}]
    try:
        value = json.loads(data.decode("utf-8-sig"))
        found = value["banks"] if "banks" in value else [value]
        return [{"name": b.get("name") or "", "questions": list(b["questions"]), "assets": {k: base64.b64decode(v, validate=True) for k, v in (b.get("assets") or {}).items()}} for b in found]
    except (UnicodeDecodeError, json.JSONDecodeError, KeyError, TypeError, AttributeError) as e:
        raise ValueError("no bank") from e


def backup(banks_: dict[str, bytes], records: bytes) -> bytes:
    """One package of several banks' packages and all records."""
    return pack({"kind": "backup", "banks": sorted(banks_)}, {f"bank/{k}": v for k, v in banks_.items()} | {"records.json": records})


def unbackup(data: bytes) -> tuple[dict[str, bytes], bytes]:
    """(banks' packages, records) of a backup, each checked before anything is returned."""
    meta, entries = unpack(data)
    found = {k[5:]: v for k, v in entries.items() if k.startswith("bank/")}
    if meta.get("kind") != "backup" or sorted(found) != meta.get("banks") or "records.json" not in entries:
        raise ValueError("the archive doesn't hold what it says")
    for package in found.values():
        unpack(package)
    return found, entries["records.json"]
