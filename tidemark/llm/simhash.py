"""SimHash near-duplicates through an embedding of bit counts.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments. A differing bit
changes one count by one, so the Manhattan distance of two embeddings never exceeds the number of differing bits and a grid
range-join under that distance finds all candidates. Two points of the integer grid at distance 2 or less have a
common grid cell within distance 1 of both: each fingerprint goes to its own cell and the neighbours, and fingerprints that
meet in a cell are verified exactly. A cell gives spanning links of its members, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import spread
from .components import components

SEGMENTS, SEGMENT_BITS = 16, 4
CROWD = 4096
HASHES = 1 << 18


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), HASHES):
        part = hashes[lo:lo + HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed=seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())), np.uint64, len(starts))
    return majority(hashes)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs(doc_id, text)``: the fingerprint as a signed long; 0 without words."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def _own_cell(fp: Column) -> Column:
    """Key of the grid cell of the embedding; a count takes four bits of the key."""
    own = F.lit(0).cast("long")
    for i in range(SEGMENTS):
        count = F.bit_count(F.shiftrightunsigned(fp, SEGMENT_BITS * i).bitwiseAND(15)).cast("long")
        own = own.bitwiseOR(F.shiftleft(count, SEGMENT_BITS * i))
    return own


def _cells(own: Column) -> Column:
    """Keys of the grid cells within Manhattan distance 1 of the cell ``own``, a column of its own: an expression would be repeated in each key."""
    near = []
    for i in range(SEGMENTS):
        # A count is 4 at most, so the last bit of its four, the sign in the top segment, stays free.
        one = 1 << SEGMENT_BITS * i
        near += [F.when(own.bitwiseAND(4 * one) == 0, own + one), F.when(own.bitwiseAND(7 * one) != 0, own - one)]
    return F.array_compact(F.array(own, *near))


def spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``fps``: each newly reached fingerprint with the one that reached it."""
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(a, b)] if (a ^ b).bit_count() <= distance else []
    links, waiting = [], fps
    while len(waiting) > 1:
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(waiting ^ at) <= distance
            reached = waiting[near]
            links += [(int(at), int(x)) for x in reached]
            front += list(reached)
            waiting = waiting[~near]
    return links


def _verified(cells: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``(a, b)`` links inside cells; fingerprints of cells with more than ``crowd`` come as ``(a, null)``.

    Rows arrive sorted by cell, so only the cell at hand is held, up to ``crowd`` rows.
    """
    def run(batches):
        cell, held, crowded = None, [], False
        signed = lambda x: x - (1 << 64) if x >> 63 else x

        def close():
            return [(signed(a), signed(b)) for a, b in spanning(np.unique(np.concatenate(held)).view(np.uint64), distance)] if held and not crowded else []

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else np.zeros(0, int)
            bounds = np.concatenate([[0], cuts, [len(keys)]])
            out = []
            # Only cells with company, and those at the ends of the batch, need a look.
            lengths = np.diff(bounds)
            for k in np.flatnonzero((lengths > 1) | (np.arange(len(lengths)) == 0) | (np.arange(len(lengths)) == len(lengths) - 1)):
                lo, hi = bounds[k], bounds[k + 1]
                if lo == hi:
                    continue
                if keys[lo] != cell:
                    out += close()
                    cell, held, crowded = keys[lo], [], False
                held.append(fps[lo:hi])
                if crowded or sum(map(len, held)) > crowd:
                    out += [(int(x), None) for part in held for x in part]
                    held, crowded = [], True
            yield links(out)
        yield links(close())

    def links(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """``(a, b)`` links between distinct fingerprints of ``prints(fp)``, enough to connect all that differ in 2 bits or fewer."""
    if distance != 2:
        raise ValueError("cells of radius 1 serve a distance of 2")
    placed = prints.select("fp", _own_cell(F.col("fp")).alias("own"))
    cells = spread(placed.select(F.explode(_cells(F.col("own"))).alias("cell"), "fp"), "cell").sortWithinPartitions("cell", "fp")
    found = materialize(_verified(cells, distance, crowd), "simhash-cells")
    # Members of crowded cells meet under every fingerprint one bit away instead: whoever shares such a key differs in at most
    # two bits, so a link to the smallest one of the key is exact and no cell has to be held.
    ones = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    many = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    flipped = many.select("fp", F.explode(F.transform(ones, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("key"))
    hubs = flipped.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return found.where("b is not null").unionByName(
        flipped.join(hubs, "key").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())


def groups(docs: DataFrame, distance: int = 2, shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text)``.

    Fingerprints that differ in ``distance`` bits or fewer are linked; ``component_id`` is the smallest id that can be reached.
    Missing texts and texts without words have fingerprint 0, linked like any other. Missing ids name no component unless
    no other id is there; repeated rows are repeated; no rows give no rows.
    """
    prints = materialize(fingerprints(docs, shingle), "simhash-prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    parts = materialize(components(near_links(distinct, distance, crowd), "simhash"), "simhash-components")
    rooted = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
