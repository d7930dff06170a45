"""Exact and near deduplication against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.llm import exact_dedup, near_dedup
from assaykit.operators.components import connected_components
from assaykit.llm.text import WORD_RE


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=200))
def test_golomb(values):
    values = np.sort(np.array(values, np.uint64))
    assert exact_dedup.golomb_decode(exact_dedup.golomb_encode(values), len(values)).tolist() == values.tolist()


def brute_exact(rows):
    kept = {}
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None:
            kept.setdefault(t, d)
    return Counter((d, kept[t]) for d, t, *_ in rows if t is not None) - Counter((d, t) for t, d in [(kept[t], kept[t]) for t in kept])


def test_exact(table, spark):
    rng = random.Random(1)
    texts = ["", "a", "b" * 200_000, "c c", "é"] + [f"text {i}" for i in range(40)]
    rows = [(i if i % 11 else None, rng.choice([*texts, None]), "en", "s") for i in range(300)] + [(5, "same id", "en", "s")] * 3
    docs = table(rows)
    found = exact_dedup.find_exact_duplicates(docs).collect()
    assert Counter((r.doc_id, r.kept_doc_id) for r in found) == brute_exact(rows)
    sizes = Counter(t for _, t, *_ in rows if t is not None)
    assert {r.copies for r in found} <= set(sizes.values())
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts_left = Counter(r.text for r in left.collect())
    assert texts_left == Counter({t: 1 for t in sizes}) + Counter({None: sum(r[1] is None for r in rows)})


def test_senders_make_messages_long(spark):
    """At 100 TB a partition alone would send each owner one fingerprint; joined to senders, a message has hundreds. Bytes a
    row are nearly the same for 4 partitions and for 64."""
    bits, owner_bits, senders = exact_dedup.plan(4 * 10**10, 800_000)
    assert 4 * 10**10 / senders / 2**owner_bits >= exact_dedup.PER_MESSAGE and 4 * 10**10 / 2**owner_bits <= exact_dedup.PER_OWNER and senders > 5000
    assert exact_dedup.plan(0, 0)[2] == 1 and exact_dedup.plan(1000, 8, 100, 10)[1:] == (4, 6)
    n, spent = 20_000, {}
    for partitions in (4, 64):
        docs = exact_dedup.with_row_id(spark.range(n, numPartitions=partitions).select(F.concat(F.lit("text "), "id").alias("text")), "row").withColumn("print", F.xxhash64("text"))
        bits, owner_bits, senders = exact_dedup.plan(n, partitions, per_owner=2000)
        sent = exact_dedup.messages(docs, bits, owner_bits, senders)
        told = sent.where("owner >= 0").agg(F.sum(F.length("code")), F.count("*"), F.sum("n")).first()
        assert told[2] == n and sent.where("owner < 0").agg(F.sum("n")).first()[0] == n
        spent[partitions] = (told[0] + 24 * told[1]) / n
    assert max(spent.values()) < 5 and spent[64] < 1.5 * spent[4]


def test_exact_over_joined_partitions(table, monkeypatch):
    monkeypatch.setattr(exact_dedup, "plan", lambda n, partitions, real=exact_dedup.plan: real(n, partitions, 50, 20))
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(150)}" if i % 9 else None, "en", "s") for i in range(400)]
    found = exact_dedup.find_exact_duplicates(table(rows, parts=9)).collect()
    assert Counter((r.doc_id, r.kept_doc_id) for r in found) == brute_exact(rows)


@pytest.mark.parametrize("rows", [[], [None, None], ["", ""], ["one"]])
def test_few_rows(table, rows):
    docs = table(rows)
    assert exact_dedup.find_exact_duplicates(docs).count() == (1 if rows == ["", ""] else 0)
    assert near_dedup.find_near_duplicates(docs).count() == 0
    assert near_dedup.drop_near_duplicates(docs).count() == len(rows)


def shingle_set(text):
    w = WORD_RE.findall((text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else set(w)


def brute_groups(rows, threshold):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return {tuple(sorted(g)) for g in groups.values() if len(g) > 1}


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


def test_near(table):
    rng = random.Random(2)
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    rows = []
    for _ in range(40):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([2, 8, 60, 300]))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.02, 0.05, 0.1]))))
    rows += [" ".join([rng.choice(VOCABULARY) for _ in range(100)] + passage) for _ in range(30)] + [None, "", "...", "a b", "b a", "x " * 20_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(rows)]
    docs = table(rows)
    found = near_dedup.find_near_duplicates(docs).collect()
    got = {}
    for r in found:
        got.setdefault(r.kept_doc_id, {r.kept_doc_id}).add(r.doc_id)
        assert r.kept_doc_id < r.doc_id
    want = brute_groups(rows, near_dedup.THRESHOLD)
    mine = {tuple(sorted(g)) for g in got.values()}
    pairs = lambda groups: {(a, b) for g in groups for a in g for b in g if a < b}
    assert pairs(mine) <= pairs(want)
    assert len(pairs(mine)) >= 0.95 * len(pairs(want))
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - len(found)


def tried(monkeypatch, docs):
    """How many pairs are verified with pivots, how many beyond these, and what is found."""
    counts, verify = {}, near_dedup._verified

    def counted(pairs, texts, threshold):
        counts[len(counts)] = pairs.count()
        return verify(pairs, texts, threshold)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    found = near_dedup.find_near_duplicates(docs).collect()
    monkeypatch.setattr(near_dedup, "_verified", verify)
    return counts[0], counts[1], found


@pytest.mark.parametrize("shared, own", [(120, 100), (150, 70)])
def test_a_shared_passage_pairs_nobody(table, monkeypatch, shared, own):
    """Documents that share most of their words, none a duplicate: pairs grow with the rows, not with their square."""
    passage = [f"p{i}" for i in range(shared)]
    n, rng = 600, random.Random(shared)
    rows = [" ".join(passage + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]
    first, second, found = tried(monkeypatch, table(rows))
    assert not found and first <= near_dedup.BANDS * n and second <= n


def test_duplicates_within_a_shared_passage(table):
    """Near copies among documents that share a passage are found, all of them."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = [f"o{rng.randrange(10**9)}" for _ in range(90)]
        rows += [" ".join(passage + edited(rng, own, 0.03)) for _ in range(1 + i % 3)]
    rows = [(i, t, "en", "s") for i, t in enumerate(rows)]
    got = {}
    for r in near_dedup.find_near_duplicates(table(rows)).collect():
        got.setdefault(r.kept_doc_id, {r.kept_doc_id}).add(r.doc_id)
    assert {tuple(sorted(g)) for g in got.values()} == brute_groups(rows, near_dedup.THRESHOLD)


def test_near_without_ids(table):
    """A null id comes after all others; repeated rows are a group, whatever their ids; a text of a million words."""
    long = " ".join(f"w{i % 9973}" for i in range(1_000_000))
    words = [f"v{i}" for i in range(60)]
    rows = [(None, " ".join(words), "en", "s"), (8, " ".join([*words[:-1], "other"]), "en", "s"), (None, long, "en", "s"), (None, long + " end", "en", "s"), (3, "", "en", "s"), (4, None, "en", "s"), (5, "x", "en", "s"), (5, "x", "en", "s")]
    found = near_dedup.find_near_duplicates(table(rows)).collect()
    assert sorted((r.kept_doc_id or -1, r.doc_id or -1, r.copies) for r in found) == [(-1, -1, 2), (5, 5, 2), (8, -1, 2)]


def test_prefixes_lose_no_pair(spark):
    """All pairs at the threshold among sets in components of their own, against brute force."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        base = rng.choice(rows)[1].split() if rows and rng.random() < 0.6 else [rng.choice(VOCABULARY[:200]) for _ in range(rng.randrange(1, 40))]
        rows.append((i, " ".join(edited(rng, base, 0.1)[: rng.randrange(1, 60)])))
    texts = spark.createDataFrame(rows, "row long, text string")
    members = spark.createDataFrame([(1, i) for i, _ in rows], "key long, rep long")
    none = spark.createDataFrame([], "node long, root long")
    for threshold in (0.3, 0.6):
        left = near_dedup._pairs_left(members, none, texts, spark.createDataFrame([], "u long, v long"), threshold)
        found = {(r.u, r.v) for r in near_dedup._verified(left, texts, threshold).collect()}
        sets = [shingle_set(t) for _, t in rows]
        assert found == {(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_sketch_is_full_and_close():
    rng = np.random.default_rng(3)
    for n in (1, 3, 50, 2000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 1 << 63, n - n * 3 // 4).astype(np.uint64)])
        s = near_dedup.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert (s != np.iinfo(np.uint64).max).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.25


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
