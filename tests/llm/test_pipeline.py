"""The pipeline, stage by stage, against plain Python over the smallest tables; and the queries that have SQL."""

import duckdb
import pytest

import corpus_pipeline
from assaykit.llm import decontaminate, langid, mixing, near_dedup
from assaykit.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_dedup import brute_groups
from tests.llm.test_scans import brute_passages


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mixing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == columns
        rows = after.collect()
        kept = {r.doc_id for r in rows}
        if name == "language_id":
            accepted = {r.doc_id for r in langid.identify_languages(docs).where("accepted").collect()}
            assert kept == accepted and len(kept) >= 0.98 * len(before)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(r.text, r.doc_id)
            assert kept == set(first.values())
        elif name == "near_dedup":
            groups = brute_groups([(r.doc_id, r.text) for r in before], near_dedup.THRESHOLD)
            assert kept == {r.doc_id for r in before} - {d for g in groups for d in g[1:]}
        elif name == "decontaminate":
            assert kept == {r.doc_id for r in before if not any(z - a >= decontaminate.DROP for _, t in bench for a, z in brute_passages(r.text, t, decontaminate.WINDOW))}
        else:
            # the flight keeps both totals; only the last two documents of each source, and of all, are drawn without the tokens
            have, got, most, n = {}, {}, {}, {}
            for into, some in ((have, before), (got, rows)):
                for r in some:
                    size = len(r.text.split())
                    into[r.source] = into.get(r.source, 0) + size
                    most[r.source] = max(size, most.get(r.source, 0))
            for r in before:
                n[r.source] = n.get(r.source, 0) + 1
            pi = mixing.chances(have, None, mixing.SHARE)
            assert all(abs(got.get(s, 0) - pi[s] * t) <= 2 * most[s] for s, t in have.items())
            assert abs(sum(got.values()) - sum(pi[s] * t for s, t in have.items())) <= 2 * max(most.values())
            assert abs(len(rows) - sum(pi[s] * k for s, k in n.items())) < 1.01
        docs, before = after, rows
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in before}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in got.columns]) for r in cursor.fetchall())
    assert sorted(repr(list(r)) for r in got.collect()) == want


ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, None, "en", None, None), (3, "the same text of some words here", "en", "s", 9), (3, "the same text of some words here", "en", "s", 9), (None, "the same text of some words here", None, "", 1), (4, "word " * 100_000, "en", "s", 5), (5, "!!!", "de", "s", 3)]


@pytest.mark.parametrize("rows", [[], ODD * 3 + [(10 + i, f"plain words number {i} of the text and more of it", "en", f"s{i % 3}", i) for i in range(40)]])
def test_odd_tables(spark, rows, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, no rows, and columns with names of the stages' own."""
    names = ["row", "mark", "copies", "language", "confidence", "__text", "folder", "tokens", "u", "key", "place"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    folder = tmp_path / "sf"
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(None, None, 1), (1, "", 2), (2, "plain words number 7", 3)], "item_id long, text string, doc_id int").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(folder)).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, docs.collect()))
    assert all(r.text and r.key == 9 for r in out)
