"""Associative scans over the chunks of a series.

A method that carries a state from row to row is written as one small element per chunk and an associative composition of
elements. What reaches a chunk is then the composition of all chunks before it (or after it), whatever the length of the series:
elements compose inside blocks of ``fan`` chunks, blocks among each other, and the two are put together, so the longest group
is ``fan`` elements for any series of up to ``fan**2`` chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

# Elements per group of one level, and numbers handled at once inside a task.
FAN = 4096
CELLS = 1 << 22
_NUMBERS = "array<double>"


class Monoid(NamedTuple):
    """Elements as rows of a matrix. ``compose(a, b)`` takes ``a`` first; ``identity`` leaves the other element as it is."""

    identity: np.ndarray
    compose: Callable[[np.ndarray, np.ndarray], np.ndarray]


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column in a row, missing ones as NaN, and the offsets of the lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets, np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return flat.to_numpy(zero_copy_only=False).astype(float), offsets - offsets[0]


def lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(flat).ravel(), pa.float64()))


def slices(lengths: np.ndarray, width: int = 1, cells: int = CELLS):
    """Places of lists, short ones first, in groups whose padded matrix holds about ``cells`` numbers at most."""
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * lengths[order[stop]] * width <= cells:
            stop += 1
        yield order[at:stop]
        at = stop


def padded(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray, fill=np.nan) -> np.ndarray:
    """Matrix of the lists at ``rows``, filled up at their ends."""
    lengths = np.diff(offsets)[rows]
    wide = np.arange(int(lengths.max(initial=0)))
    inside = wide[None, :] < lengths[:, None]
    out = np.full(inside.shape + flat.shape[1:], fill)
    out[inside] = flat[(offsets[:-1][rows][:, None] + wide)[inside]]
    return out


def exclusive(elements: np.ndarray, monoid: Monoid, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Compositions of what is before (behind, if ``reverse``) each of ``elements[row, place]``, and of all of them."""
    out = np.empty_like(elements)
    rows, places, _ = elements.shape
    so_far = np.broadcast_to(monoid.identity, (rows, len(monoid.identity))).copy()
    for t in range(places - 1, -1, -1) if reverse else range(places):
        out[:, t] = so_far
        so_far = monoid.compose(elements[:, t], so_far) if reverse else monoid.compose(so_far, elements[:, t])
    return out, so_far


def _scanned(monoid: Monoid, what: str, reverse: bool = False):
    """Arrow function over flattened lists of elements: ``total`` of each list, or the ``exclusive`` compositions inside it."""
    width = len(monoid.identity)

    @F.arrow_udf(_NUMBERS)
    def run(elements: pa.Array) -> pa.Array:
        flat, offsets = ragged(elements)
        flat, offsets = flat.reshape(-1, width), offsets // width
        lengths = np.diff(offsets)
        found = np.empty_like(flat) if what == "exclusive" else np.empty((len(lengths), width))
        with np.errstate(all="ignore"):
            for rows in slices(lengths, width):
                matrix = padded(flat, offsets, rows, monoid.identity)
                inside, total = exclusive(matrix, monoid, reverse)
                if what == "total":
                    found[rows] = total
                else:
                    for i, r in enumerate(rows):
                        found[offsets[r]:offsets[r + 1]] = inside[i, :lengths[r]]
        return lists(found, offsets * width if what == "exclusive" else np.arange(len(lengths) + 1) * width)

    return run


def composed(monoid: Monoid, first: Column, second: Column) -> Column:
    """Composition of two element columns."""
    @F.arrow_udf(_NUMBERS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        width = len(monoid.identity)
        with np.errstate(all="ignore"):
            out = monoid.compose(ragged(a)[0].reshape(-1, width), ragged(b)[0].reshape(-1, width))
        return lists(out, np.arange(len(out) + 1) * width)

    return run(first, second)


def _gathered(df: DataFrame, by: list[str], place: str) -> DataFrame:
    """One row per ``by`` with its elements in order of ``place``: ``_p`` the places, ``_e`` the elements in a row."""
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place, "element"))).alias("_l"))
    return listed.select(*by, F.transform("_l", lambda x: x[place]).alias("_p"), F.flatten(F.transform("_l", lambda x: x["element"])).alias("_e"))


def _spread(df: DataFrame, by: list[str], place: str, outs: dict[str, str], width: int) -> DataFrame:
    """Back to one row per element: ``outs`` names the columns that the scanned lists become."""
    def cut(name):
        return F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: F.slice(F.col(name), i * width + 1, width)).alias(name)
    rows = df.select(*by, F.inline(F.arrays_zip(F.col("_p").alias("_p"), *[cut(n) for n in outs])))
    return rows.select(*by, F.col("_p").alias(place), *[F.col(n).alias(new) for n, new in outs.items()])


def scan(elements: DataFrame, keys: list[str], monoid: Monoid, after: bool = False, fan: int = FAN) -> DataFrame:
    """``keys, chunk, before`` (and ``after``) for every row of ``elements(keys, chunk, element)``, one per series and chunk.

    ``before`` is the composition of the elements of all earlier chunks in order, ``after`` that of all later ones.
    """
    width = len(monoid.identity)
    sides = ["before", "after"] if after else ["before"]
    blocked = elements.select(*keys, "chunk", F.floor(F.col("chunk") / F.lit(fan)).cast("long").alias("_block"), "element")
    blocks = _gathered(blocked, [*keys, "_block"], "chunk")
    totals = blocks.select(*keys, "_block", _scanned(monoid, "total")("_e").alias("element"))
    whole = _gathered(totals, keys, "_block")
    whole = whole.withColumns({f"_{s}": _scanned(monoid, "exclusive", s == "after")("_e") for s in sides})
    outer = _spread(whole, keys, "_block", {f"_{s}": f"_outer_{s}" for s in sides}, width)
    inside = blocks.withColumns({f"_{s}": _scanned(monoid, "exclusive", s == "after")("_e") for s in sides})
    inner = _spread(inside, [*keys, "_block"], "chunk", {f"_{s}": f"_inner_{s}" for s in sides}, width)
    joined = inner.join(outer, [*keys, "_block"])
    return joined.select(*keys, "chunk", composed(monoid, F.col("_outer_before"), F.col("_inner_before")).alias("before"), *[
        composed(monoid, F.col("_inner_after"), F.col("_outer_after")).alias("after")] * after)


def fold(elements: DataFrame, keys: list[str], monoid: Monoid, chunks: int, fan: int = FAN) -> DataFrame:
    """``keys, element``: the composition of all elements of a series in order of their chunks, of which there are ``chunks`` at most.

    Every level composes groups of ``fan`` neighbours; wide elements want a small ``fan``.
    """
    left = max(1, chunks)
    rows = elements.select(*keys, "chunk", "element")
    while True:
        rows = rows.withColumn("_block", F.floor(F.col("chunk") / F.lit(fan)).cast("long")) if left > fan else rows
        by = [*keys, "_block"] if left > fan else keys
        rows = _gathered(rows, by, "chunk").select(*by, _scanned(monoid, "total")("_e").alias("element"))
        if left <= fan:
            return rows
        rows = rows.withColumnRenamed("_block", "chunk")
        left = -(-left // fan)


def carry_last(width: int) -> Monoid:
    """Elements are the last ``width`` values seen, NaN in front where there are fewer: carries them over any gap."""
    def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b], axis=1)
        order = np.argsort(~np.isnan(both), axis=1, kind="stable")
        return np.take_along_axis(both, order, axis=1)[:, width:]

    return Monoid(np.full(width, np.nan), compose)


def chunk_values(rows: DataFrame, keys: list[str], size: int, name: str) -> tuple[DataFrame, int]:
    """Values of every (series, chunk) as one array by position, written once, and the number of chunks of the longest series.

    ``keys, chunk, last_pos, x``: chunks are ``size`` positions each; rows without a value are left out, chunks without any row don't occur.
    """
    present = rows.where(F.col("value").isNotNull()).select(*keys, "pos", "value", F.floor(F.col("pos") / F.lit(size)).cast("long").alias("chunk"))
    listed = present.groupBy(*keys, "chunk").agg(F.max("pos").alias("last_pos"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_l"))
    chunks = materialize(listed.select(*keys, "chunk", "last_pos", F.transform("_l", lambda s: s["value"]).alias("x")), name)
    return chunks, int(chunks.agg(F.max("chunk")).first()[0] or 0) + 1
