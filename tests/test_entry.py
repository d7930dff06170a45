"""The driver's contract, and that the library stands without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from assaykit.functions.patterns import redact
from assaykit.plans.queries import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parent.parent
QUICK = sorted(ORACLE_SQL)


def test_flagship(spark):
    assert entry.entry(spark).count() == 11


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert told.stdout.split() == sorted(QUERIES), told.stderr


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in got.columns]) for r in cursor.fetchall())
    assert sorted(repr(list(r)) for r in got.collect()) == want


def test_phone_numbers(spark, sf):
    """Held against Python's own expressions."""
    from assaykit.functions.patterns import _PYTHON

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = sum(7 <= sum(c.isdigit() for c in m[0]) <= 15 for m in _PYTHON["phone"].finditer(f"text: {r.text}"))
        if n:
            want[r.doc_id] = n
    assert {r.doc_id: r.match_count for r in QUERIES["pii_phone"](spark, sf).collect()} == want


def test_samples_are_redacted(spark, sf):
    """Held against redaction of the whole record in Python, cut afterwards."""
    texts = {r.doc_id: f"text: {r.text}" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["pii_samples"](spark, sf).collect()
    assert rows and all(r.sample == redact(texts[r.doc_id])[:1000] and "[REDACTED_" in redact(texts[r.doc_id]) for r in rows)


def test_approximate_join_agrees(spark, sf):
    exact = {(r.doc_id, r.cluster) for r in QUERIES["near_duplicate_clusters"](spark, sf).collect()}
    close = {(r.doc_id, r.cluster) for r in QUERIES["near_duplicate_clusters_lsh"](spark, sf).collect()}
    assert len(exact & close) >= 0.9 * len(exact)


def test_counts_next_to_other_scripts(spark, tmp_path):
    """A find that a letter beyond ASCII follows counts as in the SQL."""
    texts = ["214 geieein. Stä", "电话123-45-6789号", "üjo@x.orgä", "ä10.0.0.1", "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(db.execute(ORACLE_SQL["pii_counts"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["pii_counts"](spark, str(tmp_path)).select("pattern", "n", "records").collect()) == want
    assert {p for p, _, _ in want} == {"street_address", "us_ssn", "email", "ipv4"}


def test_counts_next_to_letters_beyond_16_bits(spark, tmp_path):
    """A letter or digit that Java holds as two characters is of the word too."""
    texts = ["\U0001d7d84111-1111-1111-1111 x", "\U0001d7d8123-45-6789", "a \U0001d400 123-45-6789", "\U0001f600123-45-6789", "\U000203ff030.555.0199 \U0001d7d812-34-56-78"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("pii_matches", "pii_counts", "pii_phone"):
        got = QUERIES[name](spark, str(tmp_path))
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)
