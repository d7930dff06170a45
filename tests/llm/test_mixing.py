"""Cube-method draws: what they keep exactly, and on average."""

import random
from collections import Counter

import pytest

from assaykit.llm import mixing


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for _ in range(40):
        n = rng.randrange(0, 200)
        tokens, pi = [float(rng.choice([0, 1, 5, rng.randrange(1000)])) for _ in range(n)], [rng.choice([0.0, 1.0, rng.random()]) for _ in range(n)]
        out = mixing.flight(pi, tokens, rng)
        assert sum(0 < p < 1 for p in out) <= 2 and all(0 <= p <= 1 for p in out)
        assert sum(out) == pytest.approx(sum(pi), abs=1e-5) and sum(p * t for p, t in zip(out, tokens)) == pytest.approx(sum(p * t for p, t in zip(pi, tokens)), abs=1e-2)
        assert all(p in (0.0, 1.0) for p in mixing.landing(out, rng))


def test_flight_keeps_chances():
    rng, pi, tokens = random.Random(2), [0.2, 0.5, 0.7, 0.3, 0.9, 0.4], [3.0, 8.0, 1.0, 1.0, 20.0, 5.0]
    sums = [0.0] * 6
    for _ in range(6000):
        for i, x in enumerate(mixing.landing(mixing.flight(pi, tokens, rng), rng)):
            sums[i] += x
    assert [s / 6000 for s in sums] == pytest.approx(pi, abs=0.03)


def test_chances():
    pi = mixing.chances({"a": 1000, "b": 10, "c": 0}, None, 0.5)
    assert pi["b"] == 1 and pi["c"] == 0.5 and pi["a"] * 1000 + 10 == pytest.approx(505)
    pi = mixing.chances({"a": 100, "b": 100}, {"a": 3, "b": 1}, 0.4)
    assert pi["a"] * 100 == pytest.approx(60) and pi["b"] * 100 == pytest.approx(20)
    assert mixing.chances({}, None, 0.5) == {} and mixing.chances({"a": 5}, {}, 0.5) == {"a": 0.0}


@pytest.mark.parametrize("chunk", [50, 100_000])
def test_draw(table, chunk):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 30, 200])), "en", rng.choice(["big"] * 6 + ["mid", "small", None])) for i in range(900)]
    rows += [(None, "w w w", "en", "mid")] * 5 + [(2000, None, "en", "big"), (2001, "", "en", "empty"), (2002, "w " * 5000, "en", "mid")]
    docs = table(rows)
    drawn = mixing.mixture(docs, None, 0.3, chunk=chunk).collect()
    assert len({r.row for r in drawn}) == len(drawn)
    have, got = Counter(), Counter()
    for _, t, _, s in rows:
        have[s] += len((t or "").split())
    for r in drawn:
        got[r.source] += r.tokens
    pi = mixing.chances(dict(have), None, 0.3)
    largest = 5000
    for s in have:
        assert abs(got[s] - pi[s] * have[s]) <= largest if s == "mid" else abs(got[s] - pi[s] * have[s]) <= 400
    assert sorted((r.row for r in mixing.mixture(docs, None, 0.3, chunk=chunk).collect())) == sorted(r.row for r in drawn)


def test_the_layout_does_not_matter(table):
    """The same documents are drawn however the rows lie in partitions."""
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 90)) + f" {i}", "en", rng.choice("abc")) for i in range(300)] + [(7, "twice", "en", "a")] * 4
    drawn = [Counter((r.doc_id, r.source, r.tokens) for r in mixing.draw_mixture(table(rng.sample(rows, len(rows)), parts)).collect()) for parts in (1, 4, 7)]
    assert drawn[0] == drawn[1] == drawn[2]


def test_balance_and_chances_over_seeds(table):
    """Each draw keeps the totals of documents and tokens; over many, each document is drawn with its chance."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 9, 40])), "en", "ab"[i % 3 == 0]) for i in range(90)]
    docs = table(rows).cache()
    size = {i: len(t.split()) for i, t, *_ in rows}
    have = Counter()
    for i, _, _, s in rows:
        have[s] += size[i]
    pi = mixing.chances(dict(have), {"a": 2, "b": 1}, 0.4)
    times, seeds = Counter(), 12
    for seed in range(seeds):
        got = [r.doc_id for r in mixing.mixture(docs, {"a": 2, "b": 1}, 0.4, seed=seed, chunk=1000).collect()]
        times.update(got)
        assert abs(len(got) - sum(pi[s] for *_, s in rows)) < 1.01
        assert abs(sum(size[i] for i in got) - sum(pi[s] * t for s, t in have.items())) <= 2 * 40
        for s in "ab":
            assert abs(sum(size[i] for i in got if rows[i][3] == s) - pi[s] * have[s]) <= 2 * 40
    z = [(times[i] - seeds * pi[s]) / (seeds * pi[s] * (1 - pi[s])) ** 0.5 for i, _, _, s in rows]
    assert max(map(abs, z)) < 4.5 and abs(sum(x * x for x in z) / len(z) - 1) < 0.6


def test_keep(table):
    docs = table([f"w {i}" for i in range(60)])
    left = mixing.keep_mixture(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in mixing.draw_mixture(docs).collect()}
    assert mixing.draw_mixture(table([])).count() == 0 and mixing.keep_mixture(docs, {"s0": 1.0}).select("source").distinct().collect()[0][0] == "s0"
