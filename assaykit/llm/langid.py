"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 code points of the lower-case text, all but letters turned into single spaces;
their weight is the share of the text's n-grams times the inverse document frequency, which is counted over all
documents. The model is trained with FTRL-proximal (per-coordinate steps, elastic net) on at most SAMPLE distinct
labelled texts, in one task; they are drawn by a hash, for each label by its share of the distinct texts, but all or at
least SAMPLE / 4 / labels (once there are more than SAMPLE labels, one of each of the largest). A fifth of the sample is held out to fit the temperature
that calibrates the probabilities. The weights, a constant 1 MB, then go to all tasks.

Defined results. A null text, or one without letters, has no language, confidence 0, and is rejected. Rows without a
label take no part in training; without any labelled row no language is known and all are rejected. Of equal
probabilities the language first in the alphabet wins. Repeated rows get equal results. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import fresh, small_batches
from .text import buffers, chunks

GRAMS = 3
BITS = 16
SAMPLE = 6000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.001, 0.001
SCALE = 20.0
#: Documents of a lower calibrated confidence are rejected.
CONFIDENCE = 0.5
_MULTIPLY = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with all but letters as single spaces, and the row of each."""
    begin = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(begin))
    space = ((points < 97) | (points > 122)) & (points < 0xC0)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1] & (row[1:] == row[:-1])
    points = np.where(space, np.uint32(32), points)
    return points[keep], row[keep]


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram, in the order of the rows within each n."""
    points, row = _points(raw, offsets)
    buckets, rows, h = [], [], np.zeros(len(points), np.uint32)
    for n in range(1, GRAMS + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] ^ (h[: len(points) - n + 1] >> np.uint32(15))) + points[n - 1 :] * _MULTIPLY[n - 1]
        fine = row[: len(points) - n + 1] == row[n - 1 :]
        buckets.append(((h * np.uint32(0x27D4EB2F))[fine] >> np.uint32(32 - BITS)).astype(np.int32))
        rows.append(row[n - 1 :][fine])
    return (np.concatenate(buckets), np.concatenate(rows)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of one row begin, and their rows; a row has a run for each n."""
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    return begin, row[begin]


def _by_row(texts: pa.Array) -> Iterator[np.ndarray]:
    """The buckets of each text's n-grams."""
    raw, offsets = buffers(texts)
    for i, j in chunks(offsets):
        bucket, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        begin, of = _runs(row)
        parts: list[list[np.ndarray]] = [[] for _ in range(j - i)]
        for r, part in zip(of.tolist(), np.split(bucket, begin[1:])):
            parts[r].append(part)
        yield from (np.concatenate(p) if p else bucket[:0] for p in parts)


def row_sums(bucket: np.ndarray, row: np.ndarray, tables: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many n-grams each row has, and the sums of each table over them."""
    begin, of = _runs(row)
    n = np.bincount(of, np.diff(begin, append=len(row)), rows)
    at, sums = bucket.astype(np.intp), np.zeros((rows, len(tables)))
    for k, table in enumerate(tables):
        if len(begin):
            sums[:, k] = np.bincount(of, np.add.reduceat(np.take(table, at), begin), rows)
    return n, sums


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Texts with features, and in how many each bucket occurs, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, there = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for b in batches:
            for bucket in _by_row(b.column(0)):
                there[bucket] = True
                df += there
                there[bucket] = False
                n += len(bucket) > 0
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(some, -1)), "n": pa.array(np.append(df[some], n))})

    counts = docs.select(F.lower(F.col(text_col)).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS)
    fine = counts["bucket"] >= 0
    out[counts.loc[fine, "bucket"]] = counts.loc[fine, "n"]
    return int(counts.loc[~fine, "n"].sum()), out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int, seed: int = 1) -> np.ndarray:
    """Weights (features, classes) after FTRL-proximal over sparse rows (indices, values)."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            gg = g * g
            z[at] = zi + g - (np.sqrt(ni + gg) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + gg
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least held-out log loss, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def quotas(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """How many of each label's texts are drawn, sample at most in all."""
    sizes = dict(sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:sample])
    floor = max(1, sample // (4 * max(1, len(sizes))))
    least = {y: min(n, floor) for y, n in sizes.items()}
    free, more = sample - sum(least.values()), sum(sizes.values()) - sum(least.values())
    return {y: least[y] + min(n - least[y], free * (n - least[y]) // max(1, more)) for y, n in sizes.items()}


def draw(docs: DataFrame, text_col: str, label_col: str, sample: int) -> DataFrame:
    """t, y: distinct lower-case texts with their labels, as many of each label as quotas() says."""
    named = docs.select(F.lower(F.col(text_col)).alias("t"), F.col(label_col).cast("string").alias("y")).where(F.col("y").isNotNull() & F.col("t").isNotNull())
    named = named.withColumn("h", F.xxhash64("t", F.lit(4)))
    largest = named.select("y", "h").distinct().groupBy("y").count().orderBy(F.desc("count"), "y").limit(sample)
    sizes = {r["y"]: r["count"] for r in largest.collect()}
    # the hashes below cut are some more than wanted, so that few texts are shuffled
    wanted = [(y, k, min(1 << 30, int((1 << 30) * (1.1 * k + 4 * math.sqrt(k) + 10) / sizes[y]) + 1)) for y, k in quotas(sizes, sample).items()]
    some = named.join(F.broadcast(docs.sparkSession.createDataFrame(wanted, "y string, wanted int, cut long")), "y").where(F.shiftrightunsigned("h", 34) < F.col("cut"))
    first = F.row_number().over(Window.partitionBy("y").orderBy("h", "t"))
    return some.groupBy("y", "h", "t").agg(F.first("wanted").alias("wanted")).withColumn("place", first).where("place <= wanted").select("t", "y")


def train(docs: DataFrame, idf: np.ndarray, text_col: str, label_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    """Languages, weights times idf, temperature; from at most sample distinct labelled texts."""
    drawn = draw(docs, text_col, label_col, sample).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(t, y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())})
        names = sorted({y for _, y in found})
        rows, labels = [], []
        for bucket, (_, y) in zip(_by_row(pa.array([t for t, _ in found], pa.string())), found):
            if len(bucket):
                at, times = np.unique(bucket, return_counts=True)
                rows.append((np.append(at, 1 << BITS), np.append(times / len(bucket) * idf[at] * SCALE, 0.1)))
                labels.append(names.index(y))
        if not rows:
            return
        order = np.random.default_rng(0).permutation(len(rows))
        held, use = order[: len(order) // 5], order[len(order) // 5 :]
        labels = np.array(labels)
        w = ftrl([rows[i] for i in use], labels[use], len(names), EPOCHS)
        t = temperature(np.array([rows[i][1] @ w[rows[i][0]] for i in held]), labels[held])
        yield pa.RecordBatch.from_pydict({"names": [json.dumps(names)], "w": [w.astype(np.float32).tobytes()], "t": [t]})

    got = drawn.mapInArrow(run, "names string, w binary, t double").collect()
    if not got:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32), 1.0
    names = json.loads(got[0]["names"])
    w = np.frombuffer(got[0]["w"], np.float32).reshape(-1, len(names)).copy()
    w[:-1] *= (idf * SCALE)[:, None]
    w[-1] *= 0.1
    return names, w, got[0]["t"]


def classified(docs: DataFrame, text_col: str, columns: list[str], model: tuple[list[str], np.ndarray, float], names_of: tuple[str, str]) -> DataFrame:
    """columns of docs with the language and its confidence, under names_of."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, t = shared.value
        tables = [w[:-1, c].astype(float) for c in range(len(names))]
        for b in batches:
            raw, offsets = buffers(b.column(0))
            best, sure = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for i, j in chunks(offsets) if names else ():
                bucket, row = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n, sums = row_sums(bucket, row, tables, j - i)
                p = softmax((sums / np.maximum(n, 1)[:, None] + w[-1]) / t)
                best[i:j] = np.where(n > 0, p.argmax(axis=1), -1)
                sure[i:j] = np.where(n > 0, p.max(axis=1), 0.0)
            said = pa.array(np.array([*names, None], object)[best], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], said, pa.array(sure)], [*b.schema.names[1:], *names_of])

    schema = docs.select(*columns).schema.add(names_of[0], "string").add(names_of[1], "double")
    return docs.select(F.lower(F.col(text_col)).alias(fresh(docs, "text")), *columns).mapInArrow(run, schema)


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray, float]:
    n, df = document_frequencies(small_batches(docs), text_col)
    return train(docs, np.log((1 + n) / (1 + df)) + 1, text_col, label_col, sample)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, language, confidence, accepted for every document; see the module's text for edge cases."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    out = classified(slim, "text", ["doc_id"], fit(slim), ("language", "confidence"))
    return out.withColumn("accepted", F.col("confidence") >= CONFIDENCE)


def keep_identified(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents whose language is identified with enough confidence, with all columns as they were."""
    names = fresh(docs, "language"), fresh(docs, "confidence")
    out = classified(docs, text_col, docs.columns, fit(docs, text_col, label_col), names)
    return out.where(F.col(names[1]) >= CONFIDENCE).drop(*names)
