"""Elias-Fano sequences by round trip, and the language model against dictionaries of exact counts."""

import math
import re
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaykit.llm import lm
from assaykit.llm.eliasfano import EliasFano
from assaykit.llm.text import WORD_RE


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 1 << 40))
def test_elias_fano(values, other):
    values = np.array(sorted(set(values)), np.int64)
    code = EliasFano.encode(values, (1 << 40) + 1)
    assert code.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.append(values, other)
    assert code.find(asked).tolist() == [*range(len(values)), values.tolist().index(other) if other in values else -1]


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.integers(0, 1 << 50), st.integers(0, 3)), max_size=100))
def test_pack(rows):
    columns = [np.array([r[i] for r in rows], np.int64) for i in (0, 1)]
    assert [c.tolist() for c in lm.unpack(lm.pack(columns))] == [c.tolist() for c in columns]


def brute_force(texts):
    """Log probabilities by the module's formula, without hashes or shards."""
    docs = [WORD_RE.findall((t or "").lower()) for t in texts]
    size = len({w for d in docs for w in d}) + 2
    docs = [[*d, "$"] if d else [] for d in docs]
    seen = Counter(tuple(d[k : k + n]) for d in docs for n in (1, 2, 3) for k in range(len(d) - n + 1))
    after = Counter(h[:-1] for h in seen)

    def p(d, i):
        out = (seen[(d[i],)] + 1) / (sum(map(len, docs)) + size)
        for n in (1, 2)[:i]:
            h = tuple(d[i - n : i])
            out = (seen[(*h, d[i])] + after[h] * out) / (seen[h] + after[h]) if seen[h] else out
        return out

    def scored(text):
        d = WORD_RE.findall((text or "").lower())
        return sum(math.log(p([*d, "$"], i)) for i in range(len(d) + 1)) if d else None, sum(not seen[(w,)] for w in d)

    return scored


def test_against_brute_force(spark):
    base = "the cat sat on the mat and the dog sat on the log while the cat and the dog saw the mat".split()
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(base, rng.integers(1, 40))) + (f" rare{i}" if i % 3 == 0 else "") for i in range(60)] + [None, "", "...", "É é É", texts_long(rng, base)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").repartition(3)
    others = [*texts, "cat dog cat", "the new cat on a new mat", "new", "x " * 3000, None]
    want = brute_force(texts)
    for shard_tokens, shard_words in ((10**9, 10**9), (100, 200)):
        made = lm.train(docs, shard_tokens=shard_tokens, shard_words=shard_words)
        asked = spark.createDataFrame([(i, t, "x") for i, t in enumerate(others)], "doc_id long, text string, row string").repartition(2)
        got = {r.doc_id: r for r in lm.score(asked, made).collect()}
        for i, t in enumerate(others):
            x, unknown = want(t)
            assert got[i].unknown == unknown
            if x is None:
                assert got[i].log_probability is None and got[i].perplexity is None and got[i].words == 0
            else:
                assert got[i].log_probability == pytest.approx(x, abs=1e-6 * (got[i].words + 1))


def test_words_seen_nowhere_else(spark):
    """A text of random words must score worse than those of common ones."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(80)]
    texts = [" ".join(rng.choice(base, 60)) for _ in range(60)] + [" ".join(f"x{rng.integers(1 << 50)}" for _ in range(60)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert min(got[i].perplexity for i in range(60, 64)) > max(got[i].perplexity for i in range(60))
    assert [got[i].unknown for i in range(64)] == [0] * 60 + [60] * 4


@pytest.mark.parametrize("block, shard_tokens, shard_words", [(8 << 20, 300, 50), (50, 100, 10), (1, 10**6, 10**9)])
def test_each_text_by_the_others(spark, block, shard_tokens, shard_words):
    """Against models that are trained without the text; a word of the text alone stays in the vocabulary."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice("a b c d e f g".split(), rng.integers(1, 30))) for _ in range(12)] + ["a b own own a b own own c", "x", None, "a b c d", "a b c d", " ".join(["a b"] * 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    again = {r.doc_id: r for r in lm.score_documents(docs, shard_tokens=shard_tokens, shard_words=shard_words, block_bytes=block).collect()}
    assert all(again[i].log_probability == pytest.approx(got[i].log_probability, abs=1e-9) for i in got if got[i].words)
    size = len({w for t in texts for w in WORD_RE.findall(t or "")}) + 2
    for i, t in enumerate(texts):
        if t is None:
            assert got[i].log_probability is None
            continue
        rest = [[*WORD_RE.findall(x), "$"] for j, x in enumerate(texts) if j != i and x]
        seen = Counter(tuple(d[k : k + n]) for d in rest for n in (1, 2, 3) for k in range(len(d) - n + 1))
        d, want = [*WORD_RE.findall(t), "$"], 0.0
        for k in range(len(d)):
            p = (seen[(d[k],)] + 1) / (sum(map(len, rest)) + size)
            for n in (1, 2)[:k]:
                h = tuple(d[k - n : k])
                after = sum(x[:-1] == h and len(x) == n + 1 for x in seen)
                p = (seen[(*h, d[k])] + after * p) / (seen[h] + after) if seen[h] else p
            want += math.log(p)
        assert abs(got[i].log_probability - want) < 1e-6 * len(d)


def test_every_ngram_is_kept(spark):
    texts = ["once only here and once only there", "nothing is left out", "once only here", None]
    made = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), shard_tokens=2, shard_words=1)
    folder = Path(made["folder"].removeprefix("file:"))
    tries = [lm.Shard(lm.read_file(f"{folder}/{f.name}")) for f in folder.glob("trie-*")]
    assert len(tries) > 3
    docs = [[*WORD_RE.findall(t), "$"] for t in texts if t]
    for n, level in ((2, "level2"), (3, "level3")):
        assert sum(getattr(s, level).n for s in tries) == len({tuple(d[k : k + n]) for d in docs for k in range(len(d) - n + 1)})


def test_messages_stay_long():
    """Blocks and shards are as they are until a message would have too few entries, then grow with the root of the size."""
    assert lm.grown(10**9, lm.BLOCK_BYTES, lm.SHARD_TOKENS) == (lm.BLOCK_BYTES, lm.SHARD_TOKENS) == lm.grown(30 * 10**9, lm.BLOCK_BYTES, lm.SHARD_TOKENS)
    for size in (10**12, 10**14):
        block, tokens = lm.grown(size, lm.BLOCK_BYTES, lm.SHARD_TOKENS)
        assert block / 6 * tokens / (size / 6) > 100 and block < 1 << 29


def test_contexts_are_cut_evenly():
    """A word of half of all positions is in as many shards as its count takes."""
    c1 = np.array([5, 1000, 3, 7, 90, 2])
    shard, parts = lm.planned(c1, 100)
    assert parts.tolist() == [1, 10, 1, 1, 1, 1] and shard.tolist() == [0, 1, 0, 0, 11, 0]
    c1 = np.random.default_rng(2).zipf(1.3, 3000).clip(1, 5000)
    shard, parts = lm.planned(c1, 400)
    whole = parts == 1
    assert max(np.bincount(shard[whole], c1[whole])) <= 600 and parts.sum() - whole.sum() >= c1[~whole].sum() // 400


def texts_long(rng, base):
    return " ".join(rng.choice(base, 5000))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(docs).count() == 0
    nulls = spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")
    assert [r.log_probability for r in lm.score_documents(nulls).collect()] == [None, None]


def test_word_definition():
    assert WORD_RE.findall("naïve co-op 3x") == ["naïve", "co", "op", "3x"] and re.escape("a") == "a"


def test_memory_for_a_position():
    """What building a shard and scoring a block take is bounded, as several workers share an executor."""
    rng, size, n = np.random.default_rng(2), 5000, 1_000_000
    columns = [rng.integers(1, 60, n), rng.integers(1, size, n), rng.integers(1, size, n), np.ones(n, np.int64)]
    want = lm.Shard.build(*(c.copy() for c in columns), size)
    words = [f"w{i}" for i in rng.integers(0, 3000, n)]
    texts = [" ".join(words[i : i + 100]).encode() for i in range(0, n, 100)]
    block = lm.Block(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    block.route(np.arange(1, block.end + 1), np.zeros(block.end, np.int64), np.ones(block.end, np.int64), block.end + 2)
    c1 = np.bincount(block.p1[block.pair])
    answer = [np.bincount(block.p1, minlength=block.end), np.bincount(block.pair), np.bincount(block.pair_of), block.counts]
    answer = [answer[0][block.asker], answer[1][block.pairs_sent], answer[2][block.pairs_sent], answer[3][block.trigrams_sent]]

    def peak(f):
        tracemalloc.start()
        got = f()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got, most / n

    scored, most = peak(lambda: block.scores(c1, [answer], len(texts), n + len(texts), block.end + 2, True))
    assert most < 150
    assert np.isfinite(scored[0]).all() and len(scored[0]) == len(texts)
    got, most = peak(lambda: lm.Shard.build(*columns, size))
    assert all(np.array_equal(a, b) for a, b in zip(got, want))
    assert most < 110
