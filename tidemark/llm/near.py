"""Near-duplicate documents by word shingles: SimHash and MinHash bands find candidates, the exact Jaccard similarity decides.

SimHash comes first: fingerprints of the shingles, joined by the embedding of ``simhash``, settle what differs in 2 bits or fewer.
Texts at a similarity of 0.8 differ in about ten bits, with a wide spread, and a join under that distance misses some and meets nearly
everything. So bands find what is left: only those whose texts are still apart are looked at, and links of both ways join. Of pairs at
similarity 0.8, 20 bands of 4 rows miss 3 in 100,000.
Texts with the same words in the same order, whatever their case and white space, are one node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from . import lines, simhash
from .components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 20, 4, 0.8
CHUNK, CHARS = 4096, 1 << 22

_draws = np.random.default_rng(13)
FACTORS = _draws.integers(1, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)


class _Hashes(dict):
    """Hash per word, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        own = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return own


_hash = _Hashes()


def shingles(words: list[str], size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the runs of ``size`` words; fewer words are one run; no words have none."""
    codes = np.fromiter((_hash[w] for w in words), np.uint64, len(words))
    width = min(size, len(codes))
    if not width:
        return codes
    own = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        own = lines.mixed(own * np.uint64(lines.FACTOR) + codes[i:len(codes) - width + 1 + i])
    return np.unique(own)


def band_keys(grams: np.ndarray) -> list[int]:
    low = np.full(len(FACTORS), 0xFFFFFFFF, np.uint32)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(short), CHUNK):
        low = np.minimum(low, (short[lo:lo + CHUNK] * FACTORS).min(1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        keys = lines.mixed(keys * np.uint64(lines.FACTOR) + column.astype(np.uint64))
    return keys.view(np.int64).tolist()


def _group_links(ids: list[int], texts: list[str], least: float) -> list[tuple[int, int]]:
    """Links that connect what exact Jaccard similarity connects in one group, over word shingles."""
    grams = [shingles(t.lower().split()) for t in texts]
    links, waiting = [], list(range(len(ids)))
    while len(waiting) > 1:
        front = [waiting.pop(0)]
        while front and waiting:
            at = front.pop()
            near, rest = [], []
            for x in waiting:
                a, b = len(grams[at]), len(grams[x])
                common = 0
                if min(a, b) >= least * max(a, b) - 1e-9:
                    where = np.minimum(np.searchsorted(grams[at], grams[x]), a - 1)
                    common = int((grams[at][where] == grams[x]).sum())
                (near if common >= least * (a + b - common) - 1e-9 else rest).append(x)
            links += [(ids[at], ids[x]) for x in near]
            front += near
            waiting = rest
    return links


def similar_links(groups: list[int], ids: list[int], texts: list[str], roots: list[int], least: float) -> list[tuple[int, int]]:
    """``_group_links`` of groups of so many texts, as ``lines.similar_links``."""
    ends = np.cumsum(groups).tolist()
    return [x for n, e in zip(groups, ends) for x in _group_links(ids[e - n:e], texts[e - n:e], least)]


def _alike(prints: DataFrame) -> DataFrame:
    """``(gid, id)`` of the rows of ``prints(id, fp)`` whose fingerprints reach one another by steps of 2 bits or fewer, with company."""
    distinct = materialize(prints.groupBy("fp").agg(F.count("*").alias("n")), "near-fingerprints")
    parts = components(simhash.near_links(distinct.select("fp")), "near-fingerprints")
    rooted = distinct.join(parts, distinct["fp"] == parts["node"], "left").where("root is not null or n > 1")
    return prints.join(rooted.select("fp", F.coalesce("root", "fp").alias("gid")), "fp").select("gid", "id")


def groups(rows: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``(row, component)`` per row of ``rows(row, text)``: rows of one component are linked by similarity ``least`` or more.

    Missing texts and texts without words are equal to each other; repeated texts are looked at once.
    """
    def run(batches):
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").lower().split()
                grams = shingles(words)
                nodes.append(xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")))
                fps.append(simhash.majority(grams))
                keys.append(band_keys(grams) if words else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)],
                                              pa.array(keys, pa.list_(pa.int64()))], ["row", "id", "fp", "keys"])

    prints = materialize(rows.select("row", F.col("text").cast("string")).mapInArrow(run, "row long, id long, fp long, keys array<long>"), "near-prints")
    one = materialize(prints.groupBy("id").agg(F.min(F.struct("row", "fp")).alias("first")).select("id", "first.row", "first.fp"), "near-distinct")
    alike = materialize(_alike(one.select("id", "fp")), "near-alike")
    keyed = one.select("row", "id").join(prints.select("row", "keys"), "row").select(F.explode("keys").alias("key"), "id")
    crowded = materialize(lines._with_company(keyed), "near-crowded")
    wanted = one.select("row", "id").join(crowded.select("id").unionByName(alike.select("id")).distinct(), "id", "left_semi")
    texts = materialize(rows.select("row", F.col("text").alias("line")).join(wanted, "row").select("id", "line"), "near-texts")
    close = materialize(lines._verified(alike, texts, least, lines.BLOCK, similar_links, CHARS), "near-close")
    settled = materialize(components(close, "near-close"), "near-settled")
    rooted = crowded.join(settled, crowded["id"] == settled["node"], "left").select("key", F.coalesce("root", "id").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    linked = lines.linked(crowded.join(apart, "key", "left_semi"), texts, least, CHARS, similar_links, "near", known=close)
    return prints.join(linked, prints["id"] == linked["node"], "left").select("row", F.coalesce("root", "id").alias("component"))
