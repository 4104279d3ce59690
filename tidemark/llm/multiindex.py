"""Nearest neighbours by largest inner product over an inverted multi-index (Babenko and Lempitsky 2012).

Both halves of the vectors are quantised separately; a cell is a pair of centroids. A query walks the pairs in order of the
summed distance of its halves until the cells hold the wanted share of the entries, and their entries are
ranked by the exact product. Lists of first centroids lie side by side in blocks, and a query goes, with its bound, once to each block
that has a list within it. Cells are ordered by distance, so before quantising the inner product is made one: each entry gets
``sqrt(M^2 - |x|^2)`` as one more component, ``M`` the largest norm of all entries, and a query gets 0. Then the squared distance is
``|q|^2 + M^2 - 2qx``, and long vectors are near, as they should be. Equal vectors are one entry with its smallest ids, which is all that a result can need of them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

SAMPLE = 16_384
#: Entries and queries that meet in one group.
BLOCK, ASKED = 4096, 16_384


def centroids(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    own = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(rows, own)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(own)
        np.add.at(sums, near, rows)
        full = counts > 0
        own[full] = sums[full] / counts[full, None]
        own[~full] = rows[rng.integers(len(rows), size=int((~full).sum()))]
    return own


def nearest(rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    return ((own ** 2).sum(1)[None] - 2 * rows @ own.T).argmin(1)


def extended(rows: np.ndarray, scale: float, most: float) -> np.ndarray:
    """Entries divided by ``scale``, with the component that gives all of them the squared norm ``most``."""
    rows = rows / scale
    return np.hstack([rows, np.sqrt(np.maximum(most - (rows ** 2).sum(1), 0))[:, None]])


def halves(q: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves of a query from the centroids."""
    half = first.shape[1]
    return ((first - q[:half]) ** 2).sum(1), ((second - q[half:]) ** 2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> float:
    """How far a walk over the pairs in order of ``first[i] + second[j]`` goes until their cells hold ``wanted`` entries.

    The order of a multi-sequence walk, from one sort of all sums: for a share of most entries a heap would visit most pairs one by one.
    """
    sums = (first[:, None] + second[None, :])[counts > 0]
    order = np.argsort(sums)
    held = np.cumsum(counts[counts > 0][order])
    return float(sums[order[min(np.searchsorted(held, wanted), len(order) - 1)]])


def _entries(vectors: DataFrame, ids: int) -> tuple[DataFrame, DataFrame]:
    """Valid rows ``(vec_id, key)`` and distinct vectors ``(key, vector, ids)`` with their smallest ids.

    The rank is bounded before the shuffle, so many copies of one vector are no hot group.
    """
    valid = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    valid = valid.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0))
    sizes = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    valid = valid.where(F.size("vector") == (sizes["n"] if sizes else 0)).withColumn("key", F.xxhash64("vector"))
    valid = materialize(valid, "index-rows")
    few = valid.withColumn("rank", F.row_number().over(Window.partitionBy("key", "vector").orderBy("vec_id"))).where(F.col("rank") <= ids)
    distinct = few.groupBy("key", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    return valid, materialize(distinct.withColumn("entry", F.monotonically_increasing_id()), "index-entries")


def search(vectors: DataFrame, is_query, k: int = 20, share: float = 0.6, cells: int | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row of ``vectors(vec_id, embedding)`` with ``is_query``.

    ``is_query`` is a condition on ``vec_id``. ``share`` is the share of all entries that a query ranks exactly; ``cells`` the
    number of centroids a half (by default it grows with the square root of the entries, from 4 to 256), fitted on at most
    16,384 entries chosen by hash. Every entry is indexed and cells have no size limit. Missing ids, missing or zero vectors,
    vectors with missing or non-finite components, and those of another length than most, take no part. A row is never its own
    candidate; of repeated ids one counts; ties go to the smaller id; fewer than ``k`` candidates give fewer rows.
    """
    valid, entries = _entries(vectors, k + 1)
    n = entries.count()
    if not n:
        return valid.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Components are scaled to 1 at most, so no square of a finite one overflows.
    scale = float(entries.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double"))))).first()[0])
    square = F.aggregate("vector", F.lit(0.0), lambda held, x: held + (x.cast("double") / scale) * (x.cast("double") / scale))
    most = float(entries.agg(F.max(square)).first()[0])
    sample = extended(np.array([r["vector"] for r in entries.orderBy(F.xxhash64("entry"), "entry").select("vector").head(SAMPLE)], np.float64), scale, most)
    width = sample.shape[1] - 1
    half = max(1, width // 2)
    size = min(len(sample), cells or int(np.clip(round(math.sqrt(n) / 1.6), 4, 256)))
    first, second = (centroids(part, size) for part in (sample[:, :half], sample[:, half:]))

    def locate(batches):
        for pdf in batches:
            rows = extended(np.stack(pdf.vector.to_list()).astype(np.float64) if len(pdf) else np.zeros((0, width)), scale, most)
            yield pd.DataFrame({"entry": pdf.entry, "c1": nearest(rows[:, :half], first), "c2": nearest(rows[:, half:], second), "vector": pdf.vector, "low": pdf.low})

    placed = materialize(entries.select("entry", "vector", F.col("ids")[0].alias("low")).mapInPandas(
        locate, "entry long, c1 int, c2 int, vector array<double>, low long"), "index-cells")
    counts = np.zeros((len(first), len(second)), np.int64)
    for r in placed.groupBy("c1", "c2").count().head(counts.size):
        counts[r["c1"], r["c2"]] = r["count"]
    # A long list has blocks of its own, short ones share a block.
    blocks, base = np.maximum(-(-counts.sum(1) // BLOCK), 1), np.zeros(len(first), np.int64)
    at, room = -1, 0
    for i, (here, own) in enumerate(zip(counts.sum(1).tolist(), blocks.tolist())):
        if here > room:
            at, room = at + 1, BLOCK * own
        base[i] = at
        at, room = at + own - 1, 0 if own > 1 else room - here
    wanted = max(share * n, 4 * k)

    def probe(batches):
        for pdf in batches:
            out = []
            for entry, vector in zip(pdf.entry, pdf.vector):
                d1, d2 = halves(np.append(np.asarray(vector, np.float64) / scale, 0.0), first, second)
                bound = walk(d1, d2, counts, wanted)
                near = np.flatnonzero((counts.sum(1) > 0) & (d1 + d2.min() <= bound))
                out += [(b, entry, vector, bound) for b in sorted({int(base[i] + j) for i in near for j in range(blocks[i])})]
            yield pd.DataFrame(out, columns=["block", "query", "vector", "bound"])

    asking = materialize(valid.where(is_query).select("key", "vector").distinct().join(entries.select("key", "vector", "entry"), ["key", "vector"]).select(
        "entry", "vector"), "index-asking")
    shares = -(-asking.count() // ASKED)
    probes = asking.mapInPandas(probe, "block int, query long, vector array<double>, bound double").withColumn(
        "part", F.pmod(F.xxhash64("query"), F.lit(max(shares, 1))).cast("int"))
    per_list = [F.element_at(F.array(*[F.lit(int(x)) for x in column]), F.col("c1") + 1) for column in (base, blocks)]
    lists = placed.withColumn("block", (per_list[0] + F.pmod(F.xxhash64("entry"), per_list[1])).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(max(shares, 1) - 1))))

    def rank(asked: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(listed):
            return pd.DataFrame({"query": [], "entry": [], "low": [], "score": []}).astype({"query": "int64", "entry": "int64", "low": "int64", "score": "float64"})
        rows, low, entry = np.stack(listed.vector.to_list()), listed.low.to_numpy(), listed.entry.to_numpy()
        c1, c2 = listed.c1.to_numpy(), listed.c2.to_numpy()
        out = []
        for lo in range(0, len(asked), 256):
            part = asked.iloc[lo:lo + 256]
            vectors = np.stack(part.vector.to_list())
            for query, vector, bound, own in zip(part["query"], vectors, part.bound, vectors @ rows.T):
                d1, d2 = halves(np.append(vector / scale, 0.0), first, second)
                near = np.flatnonzero(d1[c1] + d2[c2] <= bound)
                if len(near) > k + 1:
                    # Matrix products round differently by shape, so they only select, with room, what is summed exactly below.
                    least = np.partition(own[near], len(near) - k - 1)[len(near) - k - 1]
                    near = near[own[near] >= least - 1e-9 * max(1.0, abs(least))]
                scores = (rows[near] * vector).sum(1)
                best = np.lexsort((low[near], -scores))[: k + 1]
                out.append((np.full(len(best), query), entry[near[best]], low[near[best]], scores[best]))
        return pd.DataFrame(dict(zip(("query", "entry", "low", "score"), map(np.concatenate, zip(*out)))))

    found = probes.groupBy("block", "part").cogroup(lists.groupBy("block", "part")).applyInPandas(rank, "query long, entry long, low long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "low")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).join(entries.select("entry", "ids"), "entry")
    ids = best.select("query", F.explode("ids").alias("vec_id"), "score")
    ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k + 1)
    top = ids.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("top"))
    top = materialize(top.join(entries.select(F.col("entry").alias("query"), "key", "vector"), "query").select("key", "vector", "top"), "index-found")
    queries = valid.where(is_query).select(F.col("vec_id").alias("query_id"), "key", "vector").distinct()
    own = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return queries.join(top, ["key", "vector"]).select("query_id", F.posexplode(own).alias("i", "t")).select(
        "query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))
