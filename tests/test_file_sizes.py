"""What a task reads, and what a worker holds, doesn't grow with the table."""

import random
import tracemalloc

import duckdb
import pyarrow as pa
import pyarrow.ipc as ipc
import pytest
from pyspark.sql import functions as F

from assaykit.functions import batches
from assaykit.operators import encoding
from assaykit.plans import file_queries
from assaykit.plans.queries import ORACLE_SQL, QUERIES
from assaykit.sources import arrow, storage
from assaykit.sources.files import list_files, read_records
from tests.test_records import whole


def test_a_block_is_scanned_in_windows(tmp_path):
    rng = random.Random(7)
    parts = [b"plain words " * 50, "\u00e9\u00fc".encode(), "\U0001f600".encode(), b"\xef\xbb\xbf", b"\0", b"\xff", *(p.encode() for p in encoding.MOJIBAKE)]
    data = b"".join(rng.choice(parts) for _ in range(500_000))
    (tmp_path / "x.txt").write_bytes(data)
    tracemalloc.start()
    rows = encoding.scan_windows(str(tmp_path / "x.txt"), 0, len(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts, wrong, _ = whole(data)
    issues, got = encoding.told([dict(zip(("file", "key", "at", "n", "sample"), r)) for r in rows])
    assert got == counts and wrong[0] in [i["message"] for i in issues]
    assert peak < 40 << 20 < 5 * len(data)


KINDS = ["parquet", "jsonl"]


@pytest.mark.parametrize("kind", KINDS)
def test_rows_come_in_small_batches(spark, tmp_path, kind):
    texts = spark.range(3000).select(F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1)
    (texts.write.parquet if kind == "parquet" else texts.write.json)(str(tmp_path / "t"))
    spark.conf.unset(batches._BATCH)
    files = [str(p.rename(p.with_suffix(f".{kind}"))) for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]
    read = read_records(spark, files)
    rows = texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").agg(F.max("n")).first()[0]
    assert rows <= 2 * batches.BATCH_BYTES // 10_000
    assert read.count() == 3000


READ = ["files_json", "files_arrow", "files_csv", "files_tsv", "files_txt", "schema_shapes"]


@pytest.mark.parametrize("name", READ)
def test_larger_tables_give_more_files(spark, sf, name, monkeypatch):
    """The same rows from files of a bounded size."""
    monkeypatch.setattr(file_queries, "PART_BYTES", 30_000)
    made, listed = [], file_queries.list_files
    monkeypatch.setattr(file_queries, "list_files", lambda path: (made.append(listed(path)), made[-1])[1])
    got = QUERIES[name](spark, sf)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(repr(list(r)) for r in got.collect()) == sorted(repr([dict(zip(names, r))[c] for c in got.columns]) for r in cursor.fetchall())
    assert len(made[0]) == file_queries.parts_of(sf) > file_queries.PARTS


def test_joined_files_hold_the_pieces_rows(spark, sf, monkeypatch):
    """Four files, as the SQL asks for, but of pieces that as many tasks write as the table takes."""
    monkeypatch.setattr(file_queries, "PART_BYTES", 30_000)
    wrote, written = [], file_queries.written
    monkeypatch.setattr(file_queries, "written", lambda *a: (wrote.append(written(*a)), wrote[-1])[1])
    assert sorted(map(tuple, QUERIES["file_formats"](spark, sf).collect())) == [(k, "classification", 4) for k in ("csv", "jsonl", "parquet")]
    assert [len(pieces) for pieces in wrote] == 3 * [file_queries.parts_of(sf)] and file_queries.parts_of(sf) > file_queries.PARTS
    row = ["kind", "canonical", "label"]
    for pieces, kind in zip(wrote, ("jsonl", "csv", "parquet")):
        files = file_queries._joined(spark, pieces, kind)
        assert len(files) == file_queries.PARTS
        assert sorted(map(tuple, read_records(spark, files).select(row).collect())) == sorted(map(tuple, read_records(spark, pieces).select(row).collect()))


@pytest.mark.parametrize("kind", KINDS)
def test_rows_are_read_where_they_lie(spark, sf, kind):
    """Places within files come to the rows: no row is shuffled, a block to a task, to be numbered."""
    files = file_queries.written(spark, file_queries._documents(spark, sf), kind)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_records(spark, files)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


class _Counted:
    """A file that adds up the bytes read of it."""

    closed, read_bytes = False, 0

    def __init__(self, path):
        self.raw = open(path, "rb")

    def read(self, n=-1):
        got = self.raw.read(n)
        _Counted.read_bytes += len(got)
        return got

    def __getattr__(self, name):
        return getattr(self.raw, name)


def test_arrow_batches_are_listed_without_reading_them(tmp_path, monkeypatch):
    """One process lists the batches of all files, so it must not read what is in them."""
    sizes = [300, 0, 1, 700, 45]
    rng, n = random.Random(7), sum(sizes)
    every = pa.record_batch({"text": [rng.randbytes(1000).hex() for _ in range(n)], "label": pa.array([rng.choice("ab") for _ in range(n)]).dictionary_encode()})
    schema = every.schema
    for name, options in (("plain", {}), ("packed", {"compression": "zstd"}), ("old", {"use_legacy_format": True})):
        with ipc.new_file(str(tmp_path / f"{name}.arrow"), schema, options=ipc.IpcWriteOptions(**options)) as w:
            for i, size in enumerate(sizes):
                w.write_batch(every.slice(sum(sizes[:i]), size))
    with ipc.new_file(str(tmp_path / "none.arrow"), schema):
        pass
    (tmp_path / "bad.arrow").write_bytes(b"ARROW1\0\0" + b"\xff" * 100 + b"ARROW1")
    files = sorted(map(str, tmp_path.iterdir()))
    monkeypatch.setattr(storage, "open_file", lambda path: pa.PythonFile(_Counted(path), mode="r"))
    _Counted.read_bytes = 0
    got = {}
    for b in arrow._Reader(list(enumerate(files))).partitions():
        got.setdefault(b.path.rpartition("/")[2], []).append((b.number, b.first, b.error is None))
    whole = [(i, sum(sizes[:i]), True) for i in range(len(sizes))]
    assert got == {"bad.arrow": [(-1, 0, False)], "plain.arrow": whole, "packed.arrow": whole, "old.arrow": whole}
    assert _Counted.read_bytes < 50_000 < sum(map(storage.size, files)) / 50


def test_a_batch_that_only_its_bytes_show_to_be_bad(spark, tmp_path):
    table = pa.table({"text": [f"{i} " + "x" * 50 for i in range(500)]})
    with ipc.new_file(str(tmp_path / "torn.arrow"), table.schema, options=ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table, max_chunksize=250)
    raw = (tmp_path / "torn.arrow").read_bytes()
    magic = raw.index(b"\x28\xb5\x2f\xfd")
    (tmp_path / "torn.arrow").write_bytes(raw[:magic] + b"\0" * 4 + raw[magic + 4 :])
    got = read_records(spark, [str(tmp_path / "torn.arrow")]).groupBy("kind").count().collect()
    assert sorted(map(tuple, got)) == [("file_error", 1), ("record", 250)]


@pytest.mark.parametrize("kind", ["csv", "tsv", "json"])
def test_each_file_is_a_task(spark, tmp_path, kind):
    """Files that are read from their start are read by a task each, so none reads several while others idle."""
    said = {"csv": "text,label\na,b\n", "tsv": "text\tlabel\na\tb\n", "json": '[{"text": "a", "label": "b"}]'}[kind]
    for i in range(60):
        (tmp_path / f"{i}.{kind}").write_text(said)
    read = read_records(spark, list_files(str(tmp_path))).groupBy(F.spark_partition_id()).agg(F.count_distinct("file"), F.count("*"))
    assert [tuple(r)[1:] for r in read.collect()] == [(1, 1)] * 60


@pytest.mark.parametrize("kind", ["csv", "tsv", "json"])
def test_a_file_may_end_with_a_batch(spark, tmp_path, kind):
    """Rows that fill the last batch, and a file without any."""
    said = {"csv": ("text,label\n", "a,b\n", ""), "tsv": ("text\tlabel\n", "a\tb\n", ""), "json": ("[", '{"text": "a", "label": "b"},', "]")}[kind]
    for name, n in (("full", 2000), ("none", 0)):
        (tmp_path / f"{name}.{kind}").write_text(said[0] + (n * said[1]).rstrip(",") + said[2])
    assert read_records(spark, list_files(str(tmp_path))).where("kind = 'record'").count() == 2000
