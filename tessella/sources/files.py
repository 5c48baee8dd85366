"""Requirement files: delimited text and spreadsheets."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import MISSING

#: Uploads over this many bytes are refused.
MAX_BYTES = 25 * 1024 * 1024
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text_rows(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows; bytes that are not UTF-8 are read as latin-1, rows with too many fields go, short ones are padded."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    lines = [r for r in csv.reader(io.StringIO(text)) if r]
    if not lines:
        return [], []
    n = len(lines[0])
    return lines[0], [r + [""] * (n - len(r)) for r in lines[1:] if len(r) <= n]


def _sheet_rows(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Header and rows of a workbook's first sheet."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
    first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
    rows = []
    for row in ElementTree.fromstring(z.read(first)).iter(f"{_MAIN}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{_MAIN}c"):
            column = 0
            for ch in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                column = column * 26 + ord(ch) - 64
            value = c.find(f"{_MAIN}v")
            if c.get("t") == "inlineStr":
                said = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
            elif value is None:
                continue
            else:
                said = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
            cells[column - 1] = said
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    if not rows:
        return [], []
    n = len(rows[0])
    return rows[0], [(r + [""] * n)[:n] for r in rows[1:]]


def _rows(name: str, data: bytes) -> tuple[list[str], list[list[str]]]:
    if name.endswith((".xlsx", ".xls")):
        return _sheet_rows(data)
    if name.endswith(".csv"):
        return _text_rows(data)
    raise ValueError(f"unsupported file type: {name}")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded file as a table of strings with pos, the place in the file. Missing markers are null. The file goes through Spark's reader, so any file system will do; its size is checked before its bytes are read."""
    files = spark.read.format("binaryFile").load(path)
    info = files.select("path", "length").collect()
    if len(info) != 1:
        raise ValueError("exactly one file is expected")
    if info[0]["length"] > MAX_BYTES:
        raise ValueError("file is over 25 MB")
    name = info[0]["path"]
    header, _ = _rows(name, bytes(files.select("content").first()[0]))

    def parse(frames):
        for t in frames:
            for p, content in zip(t["path"], t["content"], strict=True):
                _, rows = _rows(p, bytes(content))
                yield pd.DataFrame({"values": [[None if v in MISSING else v for v in r] for r in rows], "pos": range(len(rows))})

    parsed = files.select("path", "content").mapInPandas(parse, "values array<string>, pos long")
    return parsed.select(*[F.get("values", F.lit(i)).alias(c) for i, c in enumerate(header)], "pos")


def read_csv_folder(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Many delimited files with one header: rows with too many fields are found by the corrupt record's field count and dropped, short ones padded with null."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", _bad string"
    df = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    extra = F.from_csv(F.col("_bad"), F.lit(", ".join(f"f{i} string" for i in range(len(columns) + 1)))).getField(f"f{len(columns)}")
    kept = df.where(F.col("_bad").isNull() | extra.isNull()).drop("_bad")
    return kept.select(*[F.when(F.col(c).isin(*MISSING), None).otherwise(F.col(c)).alias(c) for c in columns])
