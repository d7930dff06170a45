"""The exact join: no pair is lost, and boilerplate pairs nobody."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import near_duplicates


def sets_of(spark, sets):
    rows = [(i % 2, i, sorted({hash((s, "x")) % (1 << 62) for s in x})) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "g int, id long, set array<long>"), [(g, i, set(x)) for g, i, x in rows]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.85, 1.0])
def test_all_pairs(spark, threshold):
    rng = random.Random(3)
    sets = []
    for _ in range(150):
        base = set(rng.choice(sets)) if sets and rng.random() < 0.7 else {rng.randrange(60) for _ in range(rng.randrange(0, 40))}
        sets.append({x if rng.random() > 0.1 else rng.randrange(60) for x in base})
    df, plain = sets_of(spark, sets)
    got = {(r.u, r.v): r.similarity for r in near_duplicates.similar_pairs(df, threshold, ["g"]).collect()}
    want = {(i, j): len(a & b) / len(a | b) for g, i, a in plain for h, j, b in plain if i < j and g == h and a and len(a & b) >= threshold * len(a | b)}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("shared, own", [(120, 100), (300, 60)])
def test_boilerplate_pairs_nobody(spark, shared, own):
    """Sets that share most of what they have, none of them similar enough: no candidates, where hash order took all pairs."""
    rng = random.Random(4)
    df, _ = sets_of(spark, [[*range(shared), *(rng.randrange(10**9) for _ in range(own))] for _ in range(400)])
    assert near_duplicates.candidate_pairs(df.where(F.size("set") > 0), 0.85, []).count() <= 400


def test_buckets_of_the_approximate_join(spark):
    """Sets that share a tenth of what they have meet in no bucket, where a table for each of the hashes took nearly all pairs;
    copies at the threshold are found."""
    rng = random.Random(6)
    own = [[*range(40), *(rng.randrange(10**9) for _ in range(160))] for _ in range(300)]
    near = [[*s[8:], *range(i * 1000 + 10**10, i * 1000 + 10**10 + 8)] for i, s in enumerate(own)]
    df, plain = sets_of(spark, own + near)
    want = {(i, i + 300) for i in range(300) if len(plain[i][2] & plain[i + 300][2]) >= 0.85 * len(plain[i][2] | plain[i + 300][2])}
    seen, verified = [], near_duplicates._verified
    near_duplicates._verified = lambda sets, pairs, t: (seen.append(pairs.count()), verified(sets, pairs, t))[1]
    try:
        got = near_duplicates.lsh_pairs(df, 0.85, ["g"], 128)
    finally:
        near_duplicates._verified = verified
    assert {(r.u, r.v) for r in got.collect()} == want and len(want) == 300
    assert seen[0] <= 320


def test_little_is_moved(spark):
    """One shuffle of the prefixes serves both sides of the join, and of the sets only those in a pair go on."""
    rng = random.Random(8)
    own = [[rng.randrange(10**9) for _ in range(100)] for _ in range(400)]
    df, _ = sets_of(spark, own + [x[:98] for x in own[:8]])
    adaptive, broadcast = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = near_duplicates.candidate_pairs(df.where(F.size("set") > 0), 0.85, ["g"])
        assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
        found = near_duplicates.similar_pairs(df, 0.85, ["g"])
        assert found.count() == 8
        assert "getbit" in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_unlike_candidates_are_not_moved(spark):
    """Parities tell candidates that are far from similar, of any length, and lose no pair at the threshold."""
    rng = random.Random(9)
    sets = []
    for size in (6, 60, 130, 500, 3000):
        base = [rng.randrange(1 << 60) for _ in range(size)]
        sets += [base, base[: -(-size * 85 // 100)], [*base[: size // 2], *(rng.randrange(1 << 60) for _ in range(size - size // 2))]]
    df = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "id long, set array<long>")
    at = {r.id: (r.n, list(r.parities)) for r in near_duplicates.with_parities(df).collect()}
    for i, x in enumerate(sets):
        n, words = at[i]
        assert n == len(x) <= 64 * len(words) <= max(64, 2 * n)
        assert sum((w & (1 << 64) - 1).bit_count() for w in words) % 2 == n % 2
    pairs = spark.createDataFrame([(i + a, i + b) for i in range(0, len(sets), 3) for a, b in ((0, 1), (0, 2), (1, 2))], "u long, v long")
    kept = {(r.u, r.v) for r in near_duplicates._maybe_similar(df, pairs, 0.85).collect()}
    assert {(i, i + 1) for i in range(0, len(sets), 3)} <= kept
    assert not kept & {(i + a, i + 2) for i in range(3, len(sets), 3) for a in (0, 1)}
    assert {(r.u, r.v) for r in near_duplicates._verified(df, pairs, 0.85).collect()} == {(i, i + 1) for i in range(0, len(sets), 3)}


def test_shingles_are_hashed_as_arrays():
    """Runs of five words within each record, each once; of fewer words, the words. No run goes on in the next record."""
    rng = random.Random(10)
    texts = [[rng.randrange(-(1 << 63), 1 << 63) if rng.random() < 0.3 else rng.randrange(4) for _ in range(n)] for n in [0, 1, 3, 4, 5, 6, 0, 40, 300, 5, 2, 0] + [rng.randrange(12) for _ in range(300)]]
    texts += [texts[8][:], texts[3][:], texts[8][::-1]]
    values, sizes = near_duplicates.shingled(np.array([w for t in texts for w in t], np.int64), np.array([len(t) for t in texts]))
    ends = np.cumsum(sizes)
    got = [values[e - n : e].tolist() for e, n in zip(ends, sizes)]
    assert all(x == sorted(set(x)) for x in got)
    named = {}
    for t, x in zip(texts, got):
        runs = {tuple(t[i : i + 5]) for i in range(len(t) - 4)} if len(t) >= 5 else {(w,) for w in t}
        assert len(x) == len(runs)
        for run in runs:
            # a run's hash by itself is its hash in any record
            alone = near_duplicates.shingled(np.array(run, np.int64), np.array([len(run)]))[0].tolist()
            assert named.setdefault(run, alone) == alone and set(alone) <= set(x)
    assert len({x for v in named.values() for x in v}) == len(named)
    assert got[-3] == got[8] != got[-1] and near_duplicates.shingled(np.array([], np.int64), np.array([0, 0]))[1].tolist() == [0, 0]


def test_sets_are_made_without_a_lambda_for_each_run(spark):
    """A lambda of Spark's for each word, run and number took most of the time."""
    fields = F.array(F.struct(F.lit("text").alias("name"), F.lit("a b c d e f a b c d e").alias("value")))
    sets = near_duplicates.with_sets(spark.range(3).select("id", fields.alias("fields")), ["id"])
    assert [(r.id, len(r.set)) for r in sets.orderBy("id").collect()] == [(i, 6) for i in range(3)]
    plan = sets._jdf.queryExecution().optimizedPlan().toString() + near_duplicates.candidate_pairs(sets, 0.85, [])._jdf.queryExecution().optimizedPlan().toString()
    assert not [f for f in ("zip_with", "array_distinct", "posexplode") if f in plan]
