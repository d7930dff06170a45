"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w x): the grades share the weights w, and ordered thresholds theta cut the score.
Features are words and beginnings of words with 1 + log(count), known by 64-bit hashes, so that none share a weight. Those
that are as frequent in toxic documents as in others, within Z standard errors, are left out; what speaks for a toxic
text and what speaks against it take part alike. w is trained with FTRL-proximal (elastic net), theta with AdaGrad under
theta_1 < theta_2 < ..., on at most SAMPLE labelled documents with distinct texts, in one task.

A label above 1 is a grade as it is. Where labels only say yes or no, they fix w and theta_1 and nothing else: the grades
from 2 on then mark how strong the evidence is, at the quantiles that the scores of the sample's toxic documents have
under models that were trained without them (two folds, features chosen anew in each). The expected severity is the sum
of P(grade > k); a document is toxic if P(grade > 0) >= 1/2.

Defined results. A null or wordless text has severity 0 and isn't toxic. Null labels and labels without a document
are ignored; of several labels of a document the highest counts; without labels every severity is 0. Documents with
equal texts get equal results. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import small_batches
from .text import buffers, chunks, word_hashes, word_spans

SAMPLE = 16_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.01
GRADES = 3
#: A feature takes part if its share of the toxic documents differs from that of the others by so many standard errors,
Z = 4.0
#: Beginnings of words, in bytes, that are features too.
PREFIXES = (4, 5, 6, 7, 8)
#: and if so many documents of the sample have it.
LEAST = 3
_COUNT = 1000
_GAP = 0.05


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def words_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunk: its first row and end, the hashes of each row's words and of their beginnings, and where each row's begin."""
    raw, offsets = buffers(texts)
    for i, j in chunks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = word_spans(part, at)
        begun = [word_hashes(part, s, np.minimum(e, s + k)) ^ np.uint64(k) for k in PREFIXES]
        yield i, j, np.stack([word_hashes(part, s, e), *begun], axis=1).ravel(), first * (1 + len(PREFIXES))


def _each(texts: list[str]) -> Iterator[np.ndarray]:
    for _, _, h, first in words_of(pa.array(texts, pa.string())):
        yield from (h[a:z] for a, z in zip(first[:-1], first[1:]))


def scores(texts: pa.Array, known: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sum of each text, and whether it has words. known: sorted hashes of the features with weights w."""
    out, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
    sieve = np.zeros(1 << 16, bool)
    sieve[known >> np.uint64(48)] = True
    for i, j, h, first in words_of(texts):
        some[i:j] = np.diff(first) > 0
        where = np.flatnonzero(sieve[h >> np.uint64(48)])
        at = np.searchsorted(known, h[where])
        fine = np.take(known, at, mode="clip") == h[where] if len(known) else np.zeros(0, bool)
        row = np.searchsorted(first, where[fine], "right") - 1
        keys, times = np.unique(row * len(known) + at[fine], return_counts=True)
        at = keys // max(1, len(known))
        np.add.at(out, i + at, w[keys % max(1, len(known))] * (1 + np.log(times)))
    return out, some


def counted(texts: list[str], group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of texts, and for each in how many texts of each group it occurs."""
    known, counts = np.zeros(0, np.uint64), np.zeros((0, groups), np.int64)
    held, of = [], []
    for i, h in enumerate(_each(texts)):
        held.append(np.unique(h))
        of.append(np.full(len(held[-1]), group[i]))
        if len(held) == _COUNT or i == len(texts) - 1:
            every = np.concatenate([known, *held])
            new, back = np.unique(every, return_inverse=True)
            sums = np.zeros((len(new), groups), np.int64)
            sums[back[: len(known)]] = counts
            np.add.at(sums, (back[len(known) :], np.concatenate(of)), 1)
            known, counts, held, of = new, sums, [], []
    return known, counts


def telling(bad: np.ndarray, fine: np.ndarray, toxic: int, other: int) -> np.ndarray:
    """Which features so many toxic and other documents have in shares that differ by Z standard errors at least, one way
    or the other."""
    n, m = max(1, toxic), max(1, other)
    p = np.clip((bad + fine) / (n + m), 1e-9, 1 - 1e-9)
    return (bad + fine >= LEAST) & (np.abs(bad / n - fine / m) >= Z * np.sqrt(p * (1 - p) * (1 / n + 1 / m)))


def featured(texts: list[str], known: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the places of its features in known, and their values."""
    out = []
    for h in _each(texts):
        at = np.searchsorted(known, h)
        k, t = np.unique(at[np.take(known, at, mode="clip") == h] if len(known) else at[:0], return_counts=True)
        out.append((k, 1 + np.log(t)))
    return out


def fit(texts: list[str], y: np.ndarray, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weights and thresholds from distinct texts with labels."""
    fold = np.random.default_rng(7).permutation(len(y)) % 2
    known, counts = counted(texts, 2 * fold + (y > 0), 4)
    sizes = np.bincount(2 * fold + (y > 0), minlength=4)

    def fitted(parts: tuple[int, ...], levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        use = telling(sum(counts[:, 2 * f + 1] for f in parts), sum(counts[:, 2 * f] for f in parts), *(int(sum(sizes[2 * f + k] for f in parts)) for k in (1, 0)))
        rows, own = featured(texts, known[use]), np.flatnonzero(np.isin(fold, parts))
        w, theta = fit_ordinal([rows[i] for i in own], y[own], levels, int(use.sum()))
        return known[use], w, theta, rows

    if y.max() > 1:
        return fitted((0, 1), int(y.max()))[:3]
    words, w, theta, _ = fitted((0, 1), 1)
    held = []
    for f in (0, 1) if (y > 0).any() and grades > 1 else ():
        _, w_f, theta_f, rows = fitted((1 - f,), 1)
        held += [rows[i][1] @ w_f[rows[i][0]] - theta_f[0] for i in np.flatnonzero((fold == f) & (y > 0))]
    for cut in np.quantile(held, np.arange(1, grades) / grades) if held else ():
        theta = np.append(theta, max(theta[0] + cut, theta[-1] + _GAP))
    return words, w, theta


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds; rows are (features, values), grades run from 0 to levels."""
    z, n = np.zeros(size), np.zeros(size)
    theta, seen = np.linspace(1, 1 + levels - 1, levels), np.full(levels, 1e-2)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            (at, x), k = rows[i], grades[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            s = x @ w
            above = sigmoid(theta[k] - s) if k < levels else 1.0
            below = sigmoid(theta[k - 1] - s) if k else 0.0
            g = (1 - above - below) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            p = max(above - below, 1e-6)
            for edge, slope in ((k, -above * (1 - above) / p), (k - 1, below * (1 - below) / p)):
                if 0 <= edge < levels:
                    slope = float(np.clip(slope, -5, 5))
                    seen[edge] += slope * slope
                    theta[edge] -= 0.3 * slope / np.sqrt(seen[edge])
            for edge in range(1, levels):
                theta[edge] = max(theta[edge], theta[edge - 1] + _GAP)
    return weights(z, n), theta


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by hash, their weights, and thresholds, from at most sample labelled documents; docs has doc_id and text,
    labels doc_id and y."""
    labels = labels.where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    cut = min(1 << 30, int((1 << 30) * sample * 1.1 / max(1, labels.count())) + 1)
    drawn = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 34) < cut).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)
    # at most sample ids, whatever the input
    sampled = docs.where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id").select(F.lower("text").alias("t"), "y").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[t] = max(y, found.get(t, 0))
        texts = sorted(found)
        if not texts:
            return
        words, w, theta = fit(texts, np.array([found[t] for t in texts]))
        yield pa.RecordBatch.from_pydict({"words": [words.tobytes()], "w": [w.tobytes()], "theta": [theta.tobytes()]})

    got = sampled.mapInArrow(run, "words binary, w binary, theta binary").collect()
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0), np.array([np.inf])
    return np.frombuffer(got[0]["words"], np.uint64), np.frombuffer(got[0]["w"]), np.frombuffer(got[0]["theta"])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, expected_severity, grade (the likeliest), is_toxic for every document; see the module's text for edge cases."""
    slim = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(slim, labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, theta = shared.value
        for b in batches:
            s, some = scores(b.column(1), known, w)
            over = sigmoid(s[:, None] - theta)
            over[~some] = 0
            p = np.concatenate([np.ones((len(s), 1)), over], axis=1) - np.concatenate([over, np.zeros((len(s), 1))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(over.sum(axis=1)), pa.array(p.argmax(axis=1)), pa.array(over[:, 0] >= 0.5)], ["doc_id", "expected_severity", "grade", "is_toxic"])

    return slim.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, "doc_id long, expected_severity double, grade long, is_toxic boolean")
