"""Files to paragraphs or cells: one row per file through ``binaryFile``, read where it lies.

The tasks' unit is a file, so any number of files is read in parallel; caps on file sizes keep a
task's memory bounded, and a file that can't be read gives a row with the error instead.
"""

from __future__ import annotations

import struct
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import legacy, office, pdf, texts

#: Extensions by reader, and the largest file of each family in MB.
WORD, EXCEL = ("docx", "docm", "dotx", "dotm"), ("xlsx", "xlsm", "xltx", "xltm")
DELIMITED, PLAIN, MARKDOWN, HTML = ("csv", "tsv"), ("txt",), ("md", "markdown"), ("html", "htm")
CAPS_MB = {**dict.fromkeys(WORD, 40), **dict.fromkeys(EXCEL, 60), **dict.fromkeys(DELIMITED + PLAIN + MARKDOWN + HTML + ("rtf",), 20), "odt": 50, "ods": 50, "doc": 50, "xls": 50, "pdf": 80}

PARAGRAPH = "path string, kind string, index int, text string, style string, num_id string, level int, list_ordinal int, table_id int, table_row int, table_col int, images array<string>, strong array<string>, weak array<string>, page int, error string"
CELL = "path string, kind string, sheet string, row int, col int, value string, formula string, images array<string>, error string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Files of known kinds with their bytes; one larger than its kind's cap comes with an error instead, and is never read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)\z", 1))
    cap = F.try_element_at(F.create_map(*(F.lit(x) for kv in CAPS_MB.items() for x in kv)), kind)
    known = df.withColumns({"kind": kind, "cap": cap}).filter("cap IS NOT NULL")
    small = known.filter("length <= cap * 1048576").withColumn("error", F.lit(None).cast("string"))
    large = known.filter("length > cap * 1048576").drop("content").withColumns({"content": F.lit(None).cast("binary"), "error": F.concat(F.lit("larger than "), F.col("cap").cast("string"), F.lit(" MB"))})
    return small.unionByName(large).drop("cap")


def paragraphs_of(kind: str, data: bytes) -> list[dict]:
    if kind in WORD:
        return office.labelled_rows(office.docx(data))[0]
    if kind == "odt":
        return [{"index": k, "text": t} for k, t in enumerate(office.odt(data))]
    if kind == "pdf":
        return pdf.paragraphs(data)
    text = texts.rtf_text(data) if kind == "rtf" else legacy.doc(data) if kind == "doc" else texts.decode_auto(data)
    if kind in HTML:
        text = texts.html_blocks(text)[0]
    elif kind in MARKDOWN:
        text = texts.markdown_plain(text)
    return [{"index": k, "text": t} for k, t in texts.lines(text)]


def cells_of(kind: str, data: bytes) -> list[dict]:
    if kind in EXCEL:
        return office.xlsx(data)
    if kind in WORD:
        used = office.labelled_rows(rows := office.docx(data))[1]
        return [c for c in office.docx_cells(rows) if int(c["sheet"][6:]) not in used]
    if kind == "ods":
        return office.ods(data)
    if kind == "xls":
        return legacy.xls(data)
    text = texts.decode_auto(data)
    rows = texts.html_blocks(text)[1] if kind in HTML else texts.table(text, "\t" if kind == "tsv" else None)
    return [{"sheet": "Sheet1", "row": r, "col": c, "value": v, "formula": None} for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v.strip()]


_FAILURES = (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, EOFError, IndexError, struct.error, RecursionError)


def _each(files: DataFrame, reader, schema: str) -> DataFrame:
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for path, kind, data, error in zip(pdf["path"], pdf["kind"], pdf["content"], pdf["error"], strict=True):
                try:
                    if error is not None:
                        raise ValueError(error)
                    rows = [dict.fromkeys(names) | {"path": path, "kind": kind} | r for r in reader(kind, bytes(data))]
                except _FAILURES as e:
                    rows = [dict.fromkeys(names) | {"path": path, "kind": kind, "error": f"{type(e).__name__}: {e}"[:200]}]
                for k in range(0, len(rows), 4096):
                    out = pd.DataFrame(rows[k : k + 4096], columns=names)
                    for c in names:
                        if f"{c} int" in schema:
                            out[c] = out[c].astype("Int32")
                    yield out

    there = files if "error" in files.columns else files.withColumn("error", F.lit(None).cast("string"))
    return there.select("path", "kind", "content", "error").mapInPandas(run, schema)


def paragraphs(files: DataFrame) -> DataFrame:
    kinds = (*WORD, "odt", "rtf", "doc", "pdf", *PLAIN, *MARKDOWN, *HTML)
    return _each(files.filter(F.col("kind").isin(*kinds)), paragraphs_of, PARAGRAPH)


def cells(files: DataFrame) -> DataFrame:
    return _each(files.filter(F.col("kind").isin(*EXCEL, *WORD, "ods", "xls", *DELIMITED, *HTML)), cells_of, CELL)
