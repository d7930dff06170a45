"""The readers over files of each kind: the documents are written as such files to the shared folder and read again.

What is read must be what the table holds, so the SQL of each query is over the table. Files are written by tasks, one a
partition, and only renamed by the driver.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.text import text_hash
from ..operators import chats, encoding, formats, schema
from ..sources import storage
from ..sources.files import byte_blocks, list_files, read_records

#: The fewest files of a table, and bytes of the table that a file takes at most: a larger table gives more files.
PARTS = 4
PART_BYTES = 32 << 20


def parts_of(sf: str) -> int:
    path = f"{sf}/documents.parquet"
    below = storage.files_below(path)
    return max(PARTS, -(-sum(storage.size(f) or 0 for f in ([path] if below is None else below)) // PART_BYTES))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; one of this machine's where there is no other."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='assaykit-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _renamed(folder: str, suffix: str) -> list[str]:
    """The folder's part files under another suffix."""
    system, at = storage.system(folder)
    for path in storage.files_below(folder) or ():
        name = path.rpartition("/")[2]
        if name.startswith("part-"):
            system.move(f"{at}/{name}", f"{at}/{name.partition('.')[0]}{suffix}")
    return list_files(folder)


def written(spark: SparkSession, table: DataFrame, kind: str, n: int = PARTS) -> list[str]:
    """table's rows as n dataset files of a kind."""
    folder = _folder(spark, kind)
    parts = table.repartition(n)
    if kind == "jsonl":
        parts.write.json(folder)
    elif kind in ("csv", "tsv"):
        parts.write.options(header=True, sep="," if kind == "csv" else "\t", quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)
    elif kind == "txt":
        parts.select("text").write.text(folder)
    elif kind == "parquet":
        parts.write.parquet(folder)
    else:
        # a document of all rows of a part, as they come
        row = F.to_json(F.struct(*table.columns), {"ignoreNullFields": "false"})
        _streamed(folder, parts.select(row.alias("row")) if kind == "json" else parts, _json if kind == "json" else _ipc)
    return _renamed(folder, f".{kind}")


def _joined(spark: SparkSession, pieces: list[str], kind: str, n: int = PARTS) -> list[str]:
    """Files of rows, written by as many tasks as there are, as n files: a task for each copies its pieces' bytes or row groups."""
    if len(pieces) <= n:
        return pieces
    folder = _folder(spark, kind)
    system, at = storage.system(folder)
    system.create_dir(at)

    def run(batches):
        for b in batches:
            for own in b.column("pieces").to_pylist():
                name = uuid.uuid4().hex
                system, at = storage.system(folder)
                with system.open_output_stream(f"{at}/_{name}") as sink:
                    (_row_groups if kind == "parquet" else _bytes)(sink, own, kind == "csv")
                yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = spark.createDataFrame([(i, pieces[i::n]) for i in range(n)], "i int, pieces array<string>").repartitionByRange(n, "i")
    for r in rows.mapInArrow(run, "name string").collect():
        system.move(f"{at}/_{r['name']}", f"{at}/part-{r['name']}.{kind}")
    return list_files(folder)


def _bytes(sink, pieces: list[str], headed: bool) -> None:
    for i, path in enumerate(pieces):
        with storage.open_file(path) as f:
            if headed and i:
                # the names are in one line, quoted
                while (held := f.read(1 << 16)) and (end := held.find(b"\n")) < 0:
                    pass
                sink.write(held[end + 1 :])
            while held := f.read(1 << 20):
                sink.write(held)


def _row_groups(sink, pieces: list[str], _) -> None:
    import pyarrow.parquet as pq

    out = None
    for path in pieces:
        with storage.open_file(path) as f:
            read = pq.ParquetFile(f)
            out = out or pq.ParquetWriter(sink, read.schema_arrow)
            for i in range(read.num_row_groups):
                out.write_table(read.read_row_group(i))
    out.close()


def _json(sink, batches) -> None:
    before = "["
    for b in batches:
        for row in b.column(0).to_pylist():
            sink.write((before + row).encode())
            before = ","
    sink.write(b"]")


def _ipc(sink, batches) -> None:
    import pyarrow.ipc

    out = None
    for b in batches:
        out = out or pyarrow.ipc.new_file(sink, b.schema)
        out.write_batch(b)
    out.close()


def _streamed(folder: str, parts: DataFrame, write) -> None:
    """A file of each part with rows, batch by batch. Only what a task names in the end is renamed, so that an attempt that
    failed leaves nothing to be read."""
    system, at = storage.system(folder)
    system.create_dir(at)

    def run(batches):
        some = (b for b in batches if b.num_rows)
        first, name = next(some, None), uuid.uuid4().hex
        if first is not None:
            system, at = storage.system(folder)
            with system.open_output_stream(f"{at}/_{name}") as sink:
                write(sink, itertools.chain([first], some))
            yield pa.RecordBatch.from_pydict({"name": [name]})

    for r in small_batches(parts).mapInArrow(run, "name string").collect():
        system.move(f"{at}/_{r['name']}", f"{at}/part-{r['name']}.written")


_DOCUMENTS = "SELECT doc_id, text, lang AS label FROM documents"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("lang").alias("label"))


def _read(kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        read = read_records(spark, written(spark, _documents(spark, sf), kind, parts_of(sf)))
        text = F.get(F.filter("fields", lambda f: f["name"] == "text"), F.lit(0))["value"]
        return read.select(F.get_json_object("canonical", "$.doc_id").cast("long").alias("doc_id"), "kind", "fmt", text_hash(text).alias("text_hash"), "label")

    return query, f"SELECT doc_id, 'record' AS kind, 'classification' AS fmt, sha256(text) AS text_hash, label FROM ({_DOCUMENTS})"


def files_txt(spark: SparkSession, sf: str) -> DataFrame:
    """Every line is a record, blank ones too."""
    lines = _documents(spark, sf).select(F.regexp_replace("text", "[\r\n]+", " ").alias("text"))
    return read_records(spark, written(spark, lines, "txt", parts_of(sf))).groupBy("fmt", text_hash(F.get("fields", F.lit(0))["value"]).alias("text_hash")).agg(F.count("*").alias("n"))


_LINES = r"SELECT regexp_replace(text, '[\r\n]+', ' ', 'g') AS text FROM documents"


def encoding_scan(spark: SparkSession, sf: str) -> DataFrame:
    """What the bytes of the same files show, summed over them."""
    lines = _documents(spark, sf).select(F.regexp_replace("text", "[\r\n]+", " ").alias("text"))
    found = encoding.scan_blocks(byte_blocks(spark, written(spark, lines, "txt", parts_of(sf)), encoding.BLOCK))
    return found.groupBy("key").agg(F.sum("n").alias("n"))


_PATTERNS = ", ".join(" || ".join(f"chr({ord(c)})" for c in p) for p in encoding.MOJIBAKE)
_ENCODING = f"""
    SELECT 'mojibake:' || p AS key, CAST(sum((length(text) - length(replace(text, p, ''))) // length(p)) AS BIGINT) AS n FROM ({_LINES}), unnest([{_PATTERNS}]) t(p) GROUP BY p
    HAVING sum(length(text) - length(replace(text, p, ''))) > 0
    UNION ALL SELECT 'null_bytes', CAST(sum(length(text) - length(replace(text, chr(0), ''))) AS BIGINT) FROM ({_LINES}) HAVING sum(length(text) - length(replace(text, chr(0), ''))) > 0"""

#: Records of every faulty shape, by the document's number: (remainder of 11, JSON in Spark's SQL, codes that it must give).
_SHAPES = [
    (0, "to_json(named_struct('prompt', text, 'chosen', text, 'rejected', lang))", ()),
    (1, "concat('{\"prompt\": null, \"chosen\": ', to_json(named_struct('a', text)), ', \"rejected\": \"other\"}')", ("missing_prompt",)),
    (2, "concat('{\"prompt\": \"some prompt\", \"chosen\": null, \"rejected\": ', doc_id, '}')", ("missing_chosen", "bad_rejected_type")),
    (3, "concat('{\"prompt\": \"some prompt\", \"chosen\": true, \"rejected\": null}')", ("bad_chosen_type", "missing_rejected")),
    (4, "concat('{\"prompt\": \"cut off ', doc_id)", ("invalid_json",)),
    (5, "''", ("empty_line",)),
    (6, "concat('[', doc_id, ']')", ("record_not_object",)),
]
_TURNS = [
    (0, '{"messages": [{"role": "user", "content": "hello there"}, {"role": "assistant", "content": "", "tool_calls": {"id": 1}}]}', ("bad_tool_calls_type",)),
    (1, '{"messages": [{"role": "user", "content": "hello there"}, {"role": "assistant", "content": "fine", "tool_calls": [{"id": 1}, {"id": 2, "type": "f"}, 3]}]}', ("bad_tool_call_object", "bad_tool_call_object")),
    (2, '{"messages": [{"role": "tool", "content": "result"}, {"role": "assistant", "content": "fine"}]}', ("bad_tool_response",)),
    (3, '{"messages": [{"role": "tool", "content": "result", "tool_call_id": "1"}, {"role": "assistant", "content": "fine"}]}', ()),
    (4, '{"messages": [{"from": "human", "value": "hello there"}, {"from": "function", "value": "r", "name": "f"}, {"from": "gpt", "value": " "}]}', ("does_not_end_assistant",)),
    (5, '{"human": "hello there", "assistant": "  "}', ("empty_assistant_turn",)),
]


def _issues_sql(rules: list[tuple], of: int) -> str:
    each = [f"SELECT doc_id, '{code}' AS code FROM documents WHERE doc_id % {of} = {k}" for k, _, codes in rules for code in codes]
    return f"SELECT code, count(*) AS n FROM ({' UNION ALL '.join(each)}) GROUP BY code"


def schema_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each fault of a record's shape is told, over files of preference pairs with all of them."""
    docs, made = spark.read.parquet(f"{sf}/documents.parquet"), F.lit(None).cast("string")
    for k, said, _ in _SHAPES:
        made = F.when(F.col("doc_id") % len(_SHAPES) == k, F.expr(said)).otherwise(made)
    files = _renamed(_text_files(spark, docs.select(made.alias("value")), parts_of(sf)), ".jsonl")
    named = spark.createDataFrame([(f, "preference_pair") for f in files], "file string, format string")
    found = schema.issues(read_records(spark, files), named)
    return found.where(F.col("severity") == "CRITICAL").groupBy("code").agg(F.count("*").alias("n"))


def chat_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """How often each fault of tool calls and turns is told, over files of chats with all of them."""
    docs, made = spark.read.parquet(f"{sf}/documents.parquet"), F.lit(None).cast("string")
    for k, said, _ in _TURNS:
        made = F.when(F.col("doc_id") % len(_TURNS) == k, F.lit(said)).otherwise(made)
    files = _renamed(_text_files(spark, docs.select(made.alias("value")), parts_of(sf)), ".jsonl")
    return chats.issues(read_records(spark, files)).groupBy("code").agg(F.count("*").alias("n"))


def file_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The shape that a file of each kind is told to have: PARTS files, whatever the table."""
    docs, out = _documents(spark, sf), None
    for kind in ("jsonl", "csv", "parquet"):
        files = _joined(spark, written(spark, docs, kind, parts_of(sf)), kind)
        one = formats.file_formats(read_records(spark, files)).groupBy("format").agg(F.count_if(F.col("sampled") > 0).alias("files")).select(F.lit(kind).alias("kind"), "format", "files")
        out = one if out is None else out.union(one)
    return out


def _text_files(spark: SparkSession, lines: DataFrame, n: int) -> str:
    folder = _folder(spark, "lines")
    lines.repartition(n).write.text(folder)
    return folder


QUERIES = {f"files_{kind}": _read(kind)[0] for kind in ("jsonl", "json", "csv", "tsv", "parquet", "arrow")} | {"files_txt": files_txt, "encoding_scan": encoding_scan, "schema_shapes": schema_shapes, "chat_tool_calls": chat_tool_calls, "file_formats": file_formats}
ORACLE_SQL = {f"files_{kind}": _read(kind)[1] for kind in ("jsonl", "json", "csv", "tsv", "parquet", "arrow")} | {
    "files_txt": f"SELECT 'raw_text' AS fmt, sha256(text) AS text_hash, count(*) AS n FROM ({_LINES}) GROUP BY text",
    "encoding_scan": _ENCODING,
    "schema_shapes": _issues_sql(_SHAPES, len(_SHAPES)),
    "chat_tool_calls": _issues_sql(_TURNS, len(_TURNS)),
    "file_formats": f"SELECT kind, 'classification' AS format, {PARTS} AS files FROM (VALUES ('jsonl'), ('csv'), ('parquet')) k(kind)",
}
