"""Dataset files as records: discovery, size guard, and a reader for each kind.

Lines of JSONL and text files are read in splits by Spark. Their numbers within the file come from two passes: each
block of the scan counts its lines, the few counts are summed up in file order, and a line's number is its block's
offset plus its place. No line is shuffled for that. Parquet rows are numbered alike, and all files of one schema are one
scan. JSON documents and CSV files are one task each, as their records can't be found from the middle.

A file that can't be read is a record of the kind file_error; the others are read all the same. What a reader asks of each
file beforehand, it asks in tasks.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records
from ..functions.batches import BATCH_BYTES, small_batches
from . import storage

EXTENSIONS = (".arrow", ".csv", ".json", ".jsonl", ".parquet", ".tsv", ".txt")
_RANKS = {"train": 0, "val": 1, "valid": 2, "validation": 3, "dev": 4, "test": 5}
_BOM = b"\xef\xbb\xbf"
_SPACE = " \t\n\r"
_NAMES = list(records.rows_of(iter(())))


class UnsupportedFile(ValueError):
    pass


def _rank(path: Path) -> tuple[int, str]:
    name = path.name.lower()
    rank = next((r for p, r in _RANKS.items() if name.startswith((f"{p}.", f"{p}_")) or name == p + path.suffix), 1)
    return rank, str(path)


def list_files(path: str) -> list[str]:
    """A folder's dataset files, splits in their usual order; a file as it is."""
    below = storage.files_below(path)
    return [path] if below is None else sorted((p for p in below if Path(p).suffix in EXTENSIONS), key=lambda p: _rank(Path(p)))


def too_large(path: str, most_gb: float) -> str | None:
    """Why a file isn't read: it isn't there, or is too large."""
    found = storage.size(path)
    if found is None:
        return f"File not found: {path}"
    gb = found / 1024**3
    return f"{path} has {gb:.2f} GB, more than max_file_size_gb={most_gb}" if gb > most_gb else None


def _told(spark: SparkSession, files: list[tuple[int, str]], ask, ddl: str) -> DataFrame:
    """file, file_ord, path and what ask says of each file, asked in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(told=[ask(p) for p in b["file"]])

    rows = [(p, i, storage.full(p)) for i, p in files]
    named = spark.createDataFrame(rows, "file string, file_ord int, path string").repartition(min(len(rows), 64))
    return named.mapInPandas(run, f"file string, file_ord int, path string, told {ddl}")


def _mapping(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    return _told(spark, files, lambda p: storage.read_range(p, 0, 3) == _BOM, "boolean").withColumnRenamed("told", "bom")


def _local(column):
    """A scan's path as storage.full() writes it."""
    return F.url_decode(F.replace(F.regexp_replace(column, "^file:/*", "/"), F.lit("+"), F.lit("%2B")))


def numbered(scan: DataFrame) -> DataFrame:
    """scan, a plain file scan, with its file's path and idx, the number of the row within it from 0."""
    marked = scan.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = marked.groupBy("__path", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("__path", "__block", "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    # a row for each block or file, however large; joined otherwise, all rows would be shuffled to them, a block to a task
    out = marked.join(F.broadcast(offsets), ["__path", "__block"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.withColumn("path", _local(F.col("__path"))).drop("__path", "__block", "__at", "__first", "__before")


def _lines(spark: SparkSession, files: list[tuple[int, str]], raw_text: bool) -> DataFrame:
    scan = numbered(spark.read.text([storage.full(p) for _, p in files])).join(F.broadcast(_mapping(spark, files)), "path")
    # the reader drops a byte-order mark, which is part of the first line
    value = F.when(F.col("bom") & (F.col("idx") == 0), F.concat(F.lit("\ufeff"), "value")).otherwise(F.col("value"))
    lines = scan.select("file", "file_ord", "idx", value.alias("value"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = (records.describe({"text": v}, raw_text=True) if raw_text else records.describe_line(v) for v in b["value"])
            yield pd.DataFrame(records.rows_of((f, o, i, i + 1, *x) for f, o, i, x in zip(b["file"], b["file_ord"], b["idx"], told)), columns=_NAMES)

    return small_batches(lines).mapInPandas(run, records.RECORD)


def json_rows(f, chunk: int = 1 << 20) -> Iterator[object]:
    """The records of a JSON document: the elements of an array one by one, as far as the document is read; the data of an
    object with such a list; or the one value."""
    held = f.read(chunk)
    while held and not held.strip(_SPACE) and (got := f.read(chunk)):
        held += got
    if not held.lstrip(_SPACE).startswith("["):
        data = json.loads(held + f.read())
        yield from data["data"] if isinstance(data, dict) and isinstance(data.get("data"), list) else [data if isinstance(data, dict) else {"__raw_json__": data}]
        return
    decoder, at, more, first = json.JSONDecoder(), held.index("[") + 1, True, True

    def skip(at: int) -> int:
        """Past white space; at the end of what is held, more is read."""
        nonlocal held, more
        while True:
            at += len(held) - at - len(held[at:].lstrip(_SPACE))
            if at < len(held) or not more:
                return at
            held, at = f.read(chunk), 0
            more = bool(held)

    while True:
        at = skip(at)
        if held[at : at + 1] == "]" and first:
            break
        while True:
            try:
                value, end = decoder.raw_decode(held, at)
            except json.JSONDecodeError:
                end = None
            if end is not None and (not more or held[end : end + 1] and held[end] in _SPACE + ",]" or end + 1000 < len(held)):
                break
            # a value that is cut off, or a number of which more may follow
            got = f.read(max(chunk, len(held) - at))
            held, at, more = held[at:] + got, 0, bool(got)
            if not more and end is None:
                value, end = decoder.raw_decode(held, at)
                break
        yield value
        at, first = skip(end), False
        if held[at : at + 1] == "]":
            break
        if held[at : at + 1] != ",":
            raise json.JSONDecodeError("Expecting ',' delimiter", held, at)
        at += 1
    at = skip(at + 1)
    if at < len(held):
        raise json.JSONDecodeError("Extra data", held, at)


def _payloads(path: str) -> Iterator[tuple[int | None, object, str | None]]:
    """Line, payload and what is wrong with it, of each record of a JSON document, CSV or TSV file."""
    kind = Path(path).suffix.lower()
    with storage.open_file(path) as raw, io.TextIOWrapper(raw, "utf-8", "replace", newline="" if kind != ".json" else None) as f:
        if kind == ".json":
            yield from ((None, r, None) for r in json_rows(f))
        else:
            for i, row in enumerate(csv.DictReader(f, dialect="excel-tab" if kind == ".tsv" else "excel")):
                more = row.pop(None, None)
                yield i + 2, dict(row), f"line {i + 2} has {len(more)} more cell(s) than the header" if more else None


def file_error(file: str, order: int, error: Exception) -> tuple:
    said = (str(error).strip() or type(error).__name__).splitlines()[-1][:500]
    return (file, order, -1, None, *records.unreadable("file_error", said, None))


def _whole(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    def rows(file: str, order: int) -> Iterator[tuple]:
        try:
            for i, (line, payload, wrong) in enumerate(_payloads(file)):
                told = records.describe(payload)
                yield (file, order, i, line, *told[: records.ERROR], wrong, *told[records.ERROR + 1 :])
        except Exception as error:  # whatever a file's bytes may be, the other files are read
            yield file_error(file, order, error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, order in zip(b["file"], b["file_ord"]):
                held, chars = [], 0
                for row in rows(file, int(order)):
                    held.append(row)
                    chars += len(row[_NAMES.index("canonical")] or "")
                    if len(held) == 2000 or chars >= BATCH_BYTES:
                        yield pd.DataFrame(records.rows_of(iter(held)), columns=_NAMES)
                        held, chars = [], 0
                # without rows a frame's columns have no type that Arrow takes
                if held:
                    yield pd.DataFrame(records.rows_of(iter(held)), columns=_NAMES)

    # by range each file is a task; dealt out in turns from several places, some tasks would get three files and others none
    named = spark.createDataFrame([(p, i) for i, p in files], "file string, file_ord int").repartitionByRange(len(files), "file_ord")
    return named.mapInPandas(run, records.RECORD)


def _footer(path: str) -> dict:
    """A Parquet file's schema, or why it has none."""
    import pyarrow.parquet as pq

    try:
        with storage.open_file(path) as f:
            schema = pq.read_schema(f).remove_metadata()
        return {"schema": "\n".join(f"{x.name}: {x.type}" for x in schema), "error": None}
    except Exception as error:  # told as the file's record
        return {"schema": None, "error": (str(error).strip() or type(error).__name__).splitlines()[-1][:500]}


def _parquet(spark: SparkSession, files: list[tuple[int, str]]) -> DataFrame:
    """Files of one schema are one scan; several schemas, a scan each. Footers are read in tasks."""
    told = _told(spark, files, _footer, "struct<schema:string,error:string>").collect()
    wrong = [r for r in told if r["told"]["schema"] is None]
    out, schema = None, arrow_schema()
    if wrong:
        out = _errors(spark, [(r["file"], r["file_ord"], r["told"]["error"]) for r in wrong])
    groups: dict[str, list] = {}
    for r in told:
        if r["told"]["schema"] is not None:
            groups.setdefault(r["told"]["schema"], []).append(r)
    for own in groups.values():
        named = spark.createDataFrame([(r["path"], r["file"], r["file_ord"]) for r in own], "path string, __file string, __ord int")
        scan = numbered(spark.read.parquet(*(r["path"] for r in own))).join(F.broadcast(named), "path")
        names = [c for c in scan.columns if c not in ("idx", "path", "__file", "__ord")]

        def run(batches, names=names, schema=schema):
            for b in batches:
                place = zip(*(b.column(c).to_pylist() for c in ("__file", "__ord", "idx")))
                rows = b.select(names).to_pylist()
                yield _batch(records.rows_of((*p, None, *records.describe(r)) for p, r in zip(place, rows)), schema)

        one = small_batches(scan.select(*names, "idx", "__file", "__ord")).mapInArrow(run, records.RECORD)
        out = one if out is None else out.union(one)
    return out


def _errors(spark: SparkSession, wrong: list[tuple[str, int, str]]) -> DataFrame:
    """A record for each file that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(records.rows_of(file_error(f, int(o), ValueError(e)) for f, o, e in zip(b["file"], b["file_ord"], b["error"])), columns=_NAMES)

    return spark.createDataFrame(wrong, "file string, file_ord int, error string").mapInPandas(run, records.RECORD)


def arrow_schema():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(records.RECORD))


def _batch(columns: dict[str, list], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([_named(v, f.type) for v in columns[f.name]], f.type) for f in schema], schema=schema)


def _named(value, kind):
    """Tuples as the structs of an Arrow type."""
    import pyarrow as pa

    if value is None:
        return None
    if pa.types.is_struct(kind):
        return {kind.field(i).name: _named(v, kind.field(i).type) for i, v in enumerate(value)}
    if pa.types.is_list(kind):
        return [_named(v, kind.value_type) for v in value]
    return value


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """All files' records, as RECORD tells; one that can't be read, or isn't there, is a record of the kind file_error. A
    file of another extension raises."""
    by_kind: dict[str, list[tuple[int, str]]] = {}
    for i, p in enumerate(files):
        by_kind.setdefault(Path(p).suffix.lower(), []).append((i, p))
    if other := set(by_kind) - set(EXTENSIONS):
        raise UnsupportedFile(f"unsupported extension {sorted(other)[0]}")
    from .arrow import read_arrow

    parts = []
    if gone := [(i, p) for some in by_kind.values() for i, p in some if storage.size(p) is None]:
        parts.append(_errors(spark, [(p, i, f"File not found: {p}") for i, p in gone]))
    for kind, every in by_kind.items():
        some = [x for x in every if x not in gone]
        if not some:
            continue
        if kind in (".jsonl", ".txt"):
            parts.append(_lines(spark, some, kind == ".txt"))
        elif kind == ".parquet":
            parts.append(_parquet(spark, some))
        elif kind == ".arrow":
            parts.append(read_arrow(spark, some))
        else:
            parts.append(_whole(spark, some))
    out = parts[0] if parts else spark.createDataFrame([], records.RECORD)
    for p in parts[1:]:
        out = out.union(p)
    return out


def byte_blocks(spark: SparkSession, files: list[str], length: int) -> DataFrame:
    """file, start, size: the blocks of so many bytes that the files are scanned in; size is the file's."""
    rows = [(f, n) for f in files if (n := storage.size(f)) is not None]
    named = spark.createDataFrame(rows, "file string, size long")
    first, step = F.lit(0).cast("long"), F.lit(length).cast("long")
    blocks = named.select("file", F.explode(F.sequence(first, F.greatest(F.col("size") - 1, first), step)).alias("start"), "size")
    return blocks.repartition(max(1, min(10_000, sum(n // length + 1 for _, n in rows))))
