"""Mixing sources to target weights by the cube method.

Each source s gets a share w_s of a token budget: the chance of its documents is pi_s = min(1, w_s L / T_s) with T_s
its tokens and L such that the expected tokens of all are SHARE of the whole; what a small source can't give goes to
the others in proportion to their weights.

Flight: within a source, three documents with fractional chances at a time move along the null space of the two
balance equations (documents, tokens) until one is 0 or 1, so both totals stay exact; the direction is drawn so
that chances are kept on average. Sources are cut into chunks by a hash of the row, at most two documents a chunk
stay fractional, and these fly again together until one chunk a source is left. What is left of all sources, two
each at most, flies under the two totals over all sources, and landing gives up first the token and then the
document total for the last two.

Defined results. A null source is a source of its own. A null or empty text has 0 tokens; a source without tokens
gives its documents with chance SHARE. Sources that targets doesn't name get nothing; without targets all get the
same weight. Repeated rows are drawn each for itself. Ties in tokens move two documents against each other. An empty
table gives an empty result. Other columns are ignored, whatever their names. The draw depends on SEED and on the
rows' ids and texts only, not on how they lie in files.
"""

from __future__ import annotations

import random
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import filter_rows, mark, materialise, stable, with_row_id

SHARE = 0.5
SEED = 20240607
CHUNK = 20_000
_EPS = 1e-9


def chances(totals: dict[str | None, int], targets: dict[str | None, float] | None, share: float) -> dict[str | None, float]:
    """Inclusion probability by source, from the tokens of each."""
    weights = {s: (1.0 if targets is None else max(0.0, targets.get(s, 0.0))) for s in totals}
    out = {s: share if weights[s] else 0.0 for s in totals if not totals[s]}
    open_, budget = {s for s in totals if totals[s] and weights[s]}, share * sum(totals.values())
    while open_:
        level = max(0.0, budget) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= totals[s]}
        if not full:
            break
        out |= dict.fromkeys(full, 1.0)
        budget -= sum(totals[s] for s in full)
        open_ -= full
    out |= {s: weights[s] * level / totals[s] for s in open_}
    return {s: out.get(s, 0.0) for s in totals}


def _move(pi: list[float], u: tuple[float, ...], draw: float) -> list[float]:
    """Along u or against it until a chance is 0 or 1, keeping each on average."""
    ahead = min((1 - p) / d if d > 0 else -p / d for p, d in zip(pi, u) if abs(d) > _EPS)
    back = min(p / d if d > 0 else (p - 1) / d for p, d in zip(pi, u) if abs(d) > _EPS)
    step = ahead if draw * (ahead + back) < back else -back
    return [0.0 if (x := p + step * d) < _EPS else 1.0 if x > 1 - _EPS else x for p, d in zip(pi, u)]


def flight(pi: list[float], tokens: list[float], rng: random.Random) -> list[float]:
    """The chances after the flight: all but two at most are 0 or 1, both totals as before."""
    pi, held = list(pi), []
    for i, p in enumerate(pi):
        if _EPS < p < 1 - _EPS:
            held.append(i)
        while len(held) == 3:
            a, b, c = (tokens[k] for k in held)
            u = (c - b, a - c, b - a)
            size = max(map(abs, u))
            u = (1.0, -1.0, 0.0) if not size else tuple(x / size for x in u)
            for k, x in zip(held, _move([pi[k] for k in held], u, rng.random())):
                pi[k] = x
            held = [k for k in held if 0 < pi[k] < 1]
    if len(held) == 2 and tokens[held[0]] == tokens[held[1]]:
        for k, x in zip(held, _move([pi[k] for k in held], (1.0, -1.0), rng.random())):
            pi[k] = x
    return pi


def landing(pi: list[float], rng: random.Random) -> list[float]:
    """The last two: first without the token total, then without the document total."""
    pi = list(pi)
    held = [i for i, p in enumerate(pi) if 0 < p < 1]
    while len(held) > 1:
        a, b = held[:2]
        pi[a], pi[b] = _move([pi[a], pi[b]], (1.0, -1.0), rng.random())
        held = [i for i in held if 0 < pi[i] < 1]
    for i in held:
        pi[i] = float(rng.random() < pi[i])
    return pi


def _fly(units: DataFrame, keys: list[str], seed: int, land: bool = False) -> DataFrame:
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "doc_id", "row"])
        rng = random.Random(f"{seed} {key}")
        pi = flight(group["pi"].tolist(), group["tokens"].astype(float).tolist(), rng)
        group["pi"] = landing(pi, rng) if land else pi
        return group.loc[group["pi"] > 0, ["row", "mark", "doc_id", "source", "tokens", "place", "pi"]]

    return units.groupBy(*keys).applyInPandas(run, "row long, mark long, doc_id long, source string, tokens long, place long, pi double")


def mixture(docs: DataFrame, targets: dict[str | None, float] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """row, mark, doc_id, source, tokens of the documents drawn. docs must be stable()."""
    spark = docs.sparkSession
    slim = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), "row")
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")
    units = materialise(slim.select("row", mark("text"), "doc_id", "source", tokens.alias("tokens"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("place")), "units")
    totals = {s: (n, t) for s, n, t in units.groupBy("source").agg(F.count("*"), F.sum("tokens")).collect()}
    pi = chances({s: t for s, (_, t) in totals.items()}, targets, share)
    by_source = spark.createDataFrame([(s, pi[s], -(-n // chunk)) for s, (n, _) in totals.items()], "s string, pi double, chunks long")
    flying = units.join(by_source, F.col("source").eqNullSafe(F.col("s"))).where("pi > 0").drop("s")

    drawn, most = [], max([-(-n // chunk) for n, _ in totals.values()], default=0)
    while True:
        flown = materialise(_fly(flying.withColumn("chunk", F.pmod("place", "chunks")).drop("chunks"), ["source", "chunk"], seed), "flown")
        drawn.append(flown.where("pi = 1"))
        flying = flown.where("pi < 1")
        if most <= 1:
            break
        most = -(-2 * most // chunk)
        flying = flying.withColumn("chunks", F.lit(most))
    drawn.append(_fly(flying.withColumn("all", F.lit(1)), ["all"], seed, land=True))
    out = drawn[0]
    for x in drawn[1:]:
        out = out.union(x)
    return out.select("row", "mark", "doc_id", "source", "tokens")


def draw_mixture(docs: DataFrame, targets: dict[str | None, float] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, tokens of the documents drawn; see the module's text for edge cases."""
    return mixture(stable(docs), targets, share, id_col, text_col, source_col).drop("row", "mark")


def keep_mixture(docs: DataFrame, targets: dict[str | None, float] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents drawn, with all columns as they were."""
    docs = stable(docs)
    return filter_rows(docs, mixture(docs, targets, share, id_col, text_col, source_col), True, text_col)
