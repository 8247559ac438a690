"""Workbooks, Stata files and SQLite exports, read and made in tasks from the bytes of files.

Files come as rows with their path and content, as Spark's binaryFile source gives them from any store, or as cells of
a table; each file is read by one task, a batch of rows at a time leaves it.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a batch that leaves a task, and of a batch that is committed to a database.
ROWS, COMMIT = 10_000, 5_000
#: Names in workbooks, and the built-in formats of numbers that are dates.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
EPOCH = datetime.datetime(1899, 12, 30)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each file of a folder or pattern."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _column(reference: str) -> int:
    out = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        out = out * 26 + ord(letter) - 64
    return out - 1


def sheet_rows(content: bytes, sheet: str | None = None) -> Iterator[list]:
    """The rows of a sheet, the first if none is named: numbers, texts, booleans, dates and None for empty cells."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    xml = lambda name: ElementTree.fromstring(book.read(name)) if name in names else None
    places = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")}
    sheets = {s.get("name"): places[s.get(f"{LINK}id")] for s in xml("xl/workbook.xml").iter(f"{MAIN}sheet")}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"there is no sheet {sheet}, only {', '.join(sheets)}")
    target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    shared = xml("xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in shared.iter(f"{MAIN}si")] if shared is not None else []
    styles, dated = xml("xl/styles.xml"), []
    if styles is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{MAIN}numFmt")}
        cells = styles.find(f"{MAIN}cellXfs")
        dated = [int(x.get("numFmtId", 0)) in DATES or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(int(x.get("numFmtId", 0)), "")))) for x in (cells if cells is not None else [])]
    part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    for _, row in ElementTree.iterparse(book.open(part)):
        if row.tag != f"{MAIN}row":
            continue
        out: list = []
        for cell in row.iter(f"{MAIN}c"):
            at, kind, value = _column(cell.get("r")) if cell.get("r") else len(out), cell.get("t", "n"), cell.find(f"{MAIN}v")
            out += [None] * (at + 1 - len(out))
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                out[at] = strings[int(value.text)]
            elif kind == "b":
                out[at] = value.text == "1"
            elif kind == "n":
                number, style = float(value.text), int(cell.get("s", 0))
                out[at] = EPOCH + datetime.timedelta(days=number) if style < len(dated) and dated[style] else int(number) if number.is_integer() else number
            else:  # the text of a formula, an error
                out[at] = value.text
        yield out
        row.clear()


def _cast(value, kind: T.DataType):
    """A cell as a column's type; what does not fit is null."""
    try:
        if value is None or value == "":
            return None
        if isinstance(kind, T.StringType):
            return value.isoformat(sep=" ") if isinstance(value, datetime.datetime) else str(value)
        if isinstance(kind, T.DateType):
            return value.date() if isinstance(value, datetime.datetime) else datetime.date.fromisoformat(str(value)[:10])
        if isinstance(kind, T.TimestampType):
            return value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, T.BooleanType):
            return bool(value)
        return int(value)
    except (TypeError, ValueError):
        return None


def read_excel(books: DataFrame, schema: str | T.StructType, sheet: str | None = None) -> DataFrame:
    """The rows under the header of a sheet of each workbook (path, content), with the path as a last column.

    Columns are found by their names in the header, whatever their order; one that a workbook lacks is null, as is a
    cell that does not fit its type. Rows without any value are left out.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = books.sparkSession.createDataFrame([], kind).toArrow().schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = sheet_rows(content, sheet)
                header = [str(x) if x is not None else None for x in next(rows, [])]
                at = [header.index(f.name) if f.name in header else -1 for f in kind.fields]
                held: list[list] = []
                for row in rows:
                    cells = [row[i] if 0 <= i < len(row) else None for i in at]
                    if any(x is not None for x in row):
                        held.append([_cast(x, f.dataType) for x, f in zip(cells, kind.fields)])
                    if len(held) == ROWS:
                        yield packed(held, path)
                        held = []
                if held:
                    yield packed(held, path)

    def packed(rows: list[list], path: str) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows))], [*arrow.names, "path"])

    return books.select("path", "content").mapInArrow(read, T.StructType([*kind.fields, T.StructField("path", T.StringType())]))


def read_stata(tables: DataFrame, schema: str | T.StructType) -> DataFrame:
    """The rows of Stata files (path, content), columns by name, with the path as a last column. Labels of values stand
    for their codes; Stata's missing values are null. A file is read in pieces of ROWS rows."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = tables.sparkSession.createDataFrame([], kind).toArrow().schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with pd.read_stata(io.BytesIO(content), chunksize=ROWS, columns=list(arrow.names)) as parts:
                    for part in parts:
                        columns = []
                        for f in arrow:
                            values = part[f.name].astype(object)
                            values = values.where(part[f.name].notna(), None)
                            columns.append(pa.array([None if v == "" and pa.types.is_string(f.type) else v for v in values], from_pandas=True).cast(f.type))
                        yield pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(part))], [*arrow.names, "path"])

    return tables.select("path", "content").mapInArrow(read, T.StructType([*kind.fields, T.StructField("path", T.StringType())]))


def export_sqlite(records: DataFrame, key: str, document: str, shards: int = 1) -> DataFrame:
    """shard, inserted, skipped and database (bytes): the texts of JSON documents under their keys, in SQLite databases
    with a table chunks (key, text).

    Records are dealt to shards by their keys, so that a key is in one database and of equal keys the greatest document
    stays. A record with a null key, without a text, or that is no JSON object is skipped. Rows are inserted in batches
    of COMMIT; a database is in memory until it is handed on, so choose shards by the size of the export.
    """
    shard = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int")
    dealt = records.select(shard.alias("shard"), F.col(key).cast("string").alias("key"), F.col(document).alias("document")).repartition(shards, "shard").sortWithinPartitions("shard", "key", "document")

    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base, rows, skipped = None, None, [], 0

        def flush() -> None:
            with base:
                base.executemany("INSERT OR REPLACE INTO chunks (key, text) VALUES (?, ?)", rows)
            rows.clear()

        def finished() -> pa.RecordBatch:
            flush()
            n = base.execute("SELECT COUNT(*) FROM chunks").fetchone()[0]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([n]), pa.array([skipped]), pa.array([base.serialize()], pa.binary())], ["shard", "inserted", "skipped", "database"])

        for batch in batches:
            for at, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                if at != now:
                    if now is not None:
                        yield finished()
                        base.close()
                    now, base, skipped = at, sqlite3.connect(":memory:"), 0
                    base.execute("CREATE TABLE chunks (key TEXT PRIMARY KEY, text TEXT NOT NULL)")
                try:
                    value = json.loads(text)["text"]
                    if name is None or not isinstance(value, str):
                        raise ValueError
                except (ValueError, TypeError, KeyError):
                    skipped += 1
                    continue
                rows.append((name, value))
                if len(rows) == COMMIT:
                    flush()
        if now is not None:
            yield finished()

    return dealt.mapInArrow(export, "shard int, inserted long, skipped long, database binary")


def read_sqlite(databases: DataFrame) -> DataFrame:
    """key and text of all rows of exported databases."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                base = sqlite3.connect(":memory:")
                base.deserialize(data)
                found = base.execute("SELECT key, text FROM chunks ORDER BY key")
                while rows := found.fetchmany(ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["key", "text"])
                base.close()

    return databases.select("database").mapInArrow(read, "key string, text string")
