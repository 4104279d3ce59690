"""Best-fit packing by a grouping genetic algorithm (Falkenauer 1996) on islands with elite migration.

Documents become token ids, those longer than a sequence are cut into pieces. Pieces shorter than a sequence are dealt evenly
into blocks of a few thousand. Several islands evolve packings of each block: crossover injects whole well-filled bins of one
parent into the other, removes the bins that hold a duplicate, and best-fits the displaced pieces. Between epochs the elite
of an island moves to the next one. Pieces in loosely filled bins of all blocks are dealt and packed once more.
"""

from __future__ import annotations

import os
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import spread

CAPACITY = 2048
BLOCK = 4096
CACHE = 500_000
#: Latin letters that no normalisation takes apart, and marks behind them.
WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?$%&*#]*)")


class WordIds:
    """Ids of texts, as bytes of little-endian 32-bit numbers; each chunk between white space is encoded once and kept.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its chunks in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.ids: dict[bytes, bytes] = {}

    def _plain(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        """Ids of new chunks. A chunk of Latin letters is one word of the tokenizer, so many are encoded in one text and told
        apart by the pieces that close a word; marks behind such a chunk are a word of their own."""
        words, tailed, other = set(), [], []
        for w in new:
            m = WORD.fullmatch(w)
            if m is None:
                other.append(w)
            elif m.end(1) == len(w):
                words.add(w)
            else:
                tailed.append((w, w[:m.end(1)], w[m.end(1):]))
        letters = list(words.union(stem for _, stem, _ in tailed).difference(self.ids))
        other += {tail for _, _, tail in tailed}.difference(self.ids, other)
        groups = [letters[lo:lo + 256] for lo in range(0, len(letters), 256)]
        for at in range(0, len(groups), 32):
            part = groups[at:at + 32]
            for words, e in zip(part, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in part], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = (np.flatnonzero(self.closes[ids]) + 1) * 4
                flat = ids.tobytes()
                self.ids.update(zip(words, [flat[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())], strict=True))
        for at in range(0, len(other), 8192):
            self.ids.update(zip(other[at:at + 8192], self._plain(other[at:at + 8192])))
        for w, stem, tail in tailed:
            self.ids[w] = self.ids[stem] + self.ids[tail]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        # Lower case saves look-ups; special tokens are told by case, so texts that may hold one stay as they are.
        split = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts]
        for lo in range(0, len(split), 256):
            some = split[lo:lo + 256]
            new = list(set().union(*some).difference(self.ids))
            if len(self.ids) + len(new) > CACHE:
                self.ids.clear()
                new = list(set().union(*some))
            self._learn(new)
            for i, words in enumerate(some, lo):
                split[i] = b"".join(map(self.ids.__getitem__, words))
        return split


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of the token ids of each row of ``docs(doc_id, text)`` and the id ``end``.

    ``with_ids`` adds the binary column ``ids``.

    Only documents longer than ``capacity`` are cut. A missing or empty text is the end alone; rows are never merged.
    """
    stop = np.array([end], "<u4").tobytes()
    size = 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches):
        encoder = word_ids(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for lo in range(0, len(ids), 1024):
                rows = []
                for doc_id, tokens in zip(ids[lo:lo + 1024], encoder.encode(texts.slice(lo, 1024).to_pylist())):
                    tokens += stop
                    for k, at in enumerate(range(0, len(tokens), size)):
                        part = tokens[at:at + size]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(sizes: list[int], items, bins: list[list[int]], free: list[int], capacity: int) -> None:
    """Put ``items``, largest first, where least space is left; ``bins`` and their ``free`` space are extended in place.

    Bit r of ``open_`` says that a bin with r free places exists, so the tightest fit is the lowest bit from the size on.
    """
    by_free: dict[int, list[int]] = {}
    open_ = 0
    for b, f in enumerate(free):
        by_free.setdefault(f, []).append(b)
        open_ |= 1 << f
    for i in items:
        size = sizes[i]
        fits = open_ >> size
        if fits:
            left = (fits & -fits).bit_length() - 1
            own = by_free[left + size]
            b = own.pop()
            if not own:
                open_ ^= 1 << (left + size)
        else:
            b, left = len(bins), capacity - size
            bins.append([])
            free.append(capacity)
        bins[b].append(i)
        free[b] = left
        by_free.setdefault(left, []).append(b)
        open_ |= 1 << left


def score(free: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then uneven filling, which keeps free space together."""
    return -len(free), sum((1 - f / capacity) ** 2 for f in free)


def crossover(a, b, sizes: list[int], capacity: int, rng: random.Random):
    """A child of two packings ``(bins, free)``: well-filled bins of ``a`` go whole into ``b``."""
    good = [k for k, f in enumerate(a[1]) if f * 50 <= capacity]
    taken = set(rng.sample(good, len(good) // 2)) if good else set()
    moved = {i for k in taken for i in a[0][k]}
    bins, free, displaced = [list(a[0][k]) for k in taken], [a[1][k] for k in taken], []
    for own, f in zip(*b):
        inside = [i for i in own if i not in moved]
        # A bin that holds a duplicate goes; so does a loose one, whose items may now find a tighter place.
        if len(inside) < len(own) or f * 50 > capacity:
            displaced += inside
        else:
            bins.append(list(own))
            free.append(f)
    # A little noise in the order keeps children of equal parents apart.
    displaced.sort(key=lambda i: -sizes[i] * rng.uniform(0.9, 1.0))
    best_fit(sizes, displaced, bins, free, capacity)
    return bins, free


def packed(assigned: list[int], sizes: list[int], capacity: int):
    bins: list[list[int]] = [[] for _ in range(max(assigned, default=-1) + 1)]
    free = [capacity] * len(bins)
    for i, b in enumerate(assigned):
        bins[b].append(i)
        free[b] -= sizes[i]
    return bins, free


def evolve(sizes: list[int], elites: list[list[int]], capacity: int, seed: int, population: int, generations: int) -> list[tuple[float, list[int]]]:
    """The two best packings after some generations, as (score, bin of each item); ``elites`` join the first population."""
    rng = random.Random(seed)
    total = -(-sum(sizes) // capacity)
    people = [packed(e, sizes, capacity) for e in elites]
    while len(people) < population:
        spread_ = 0.0 if not people else rng.uniform(0.02, 0.3)
        bins, free = [], []
        best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i] * rng.uniform(1 - spread_, 1.0)), bins, free, capacity)
        people.append((bins, free))
    people.sort(key=lambda p: score(p[1], capacity), reverse=True)
    for _ in range(generations):
        if len(people[0][1]) <= total:
            break
        a, b = rng.sample(people[: max(2, population // 2)], 2)
        people[-1] = crossover(a, b, sizes, capacity, rng)
        people.sort(key=lambda p: score(p[1], capacity), reverse=True)
    best = []
    for bins, free in people[:2]:
        where = [0] * len(sizes)
        for k, own in enumerate(bins):
            for i in own:
                where[i] = k
        count, even = score(free, capacity)
        best.append((count + even / (1 + len(free)), where))
    return best


def _islands(blocks: DataFrame, capacity: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """``(block, sizes, bins)``: the best packing that the islands of each block find."""
    schema = "block long, island int, sizes array<int>, score double, bins array<int>"

    def run(batches):
        for pdf in batches:
            out = []
            for block, island, epoch, sizes, elites in zip(pdf.block, pdf.island, pdf.epoch, pdf.sizes, pdf.elites):
                own = [int(x) for x in sizes]
                seed = zlib.crc32(f"{block}.{island}.{epoch}".encode())
                for points, where in evolve(own, [[int(x) for x in e] for e in elites], capacity, seed, population, generations):
                    out.append((block, island, own, points, where))
            yield pd.DataFrame(out, columns=["block", "island", "sizes", "score", "bins"])

    found = blocks.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")).withColumn(
        "elites", F.expr("cast(array() as array<array<int>>)"))
    for epoch in range(epochs):
        found = spread(found.withColumn("epoch", F.lit(epoch)), "block", "island").mapInPandas(run, schema)
        if epoch + 1 < epochs:
            # Elites stay on their island and migrate to the next one.
            found = found.withColumn("to", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands))).groupBy(
                "block", F.col("to").alias("island")).agg(F.first("sizes").alias("sizes"), F.collect_list("bins").alias("elites"))
    return found.groupBy("block").agg(F.max_by("bins", "score").alias("bins"))


def _pack_blocks(items: DataFrame, capacity: int, **ga) -> DataFrame:
    """``(key, block, bin)`` for ``items(key, length)``; keys are unique, so blocks are even whatever the documents are."""
    blocks = max(1, -(-items.count() // BLOCK))
    listed = items.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("key", F.col("length").cast("int").alias("length")))).alias("items"))
    listed = materialize(listed, "packing-blocks")
    best = _islands(listed.select("block", F.col("items.length").alias("sizes")), capacity, **ga)
    return listed.join(best, "block").select("block", F.explode(F.arrays_zip("items.key", "bins")).alias("x")).select(
        F.col("x.key").alias("key"), "block", F.col("x.bins").alias("bin"))


def pack(parts: DataFrame, capacity: int = CAPACITY, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 8) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` tokens, gapless from offset 0.

    ``parts`` needs a ``length`` from 1 to ``capacity``; repeated rows are packed as often as they come; no rows give no rows.
    """
    ga = {"islands": islands, "epochs": epochs, "population": population, "generations": generations}
    keyed = materialize(parts.drop("sequence_id", "offset").withColumn("key", F.monotonically_increasing_id()), "packing-parts")
    short = keyed.where(F.col("length") < capacity).select("key", "length")
    first = materialize(_pack_blocks(short, capacity, **ga).join(short, "key"), "packing-first")
    fill = first.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
    loose = fill.where(F.col("fill") < capacity * 0.98).select("block", "bin")
    again = materialize(first.join(loose, ["block", "bin"], "left_semi").select("key", "length"), "packing-loose")
    second = _pack_blocks(again, capacity, **ga).join(again, "key").withColumn("round", F.lit(1))
    bins = first.join(loose, ["block", "bin"], "left_anti").withColumn("round", F.lit(0)).unionByName(second)
    # A bin holds at most ``capacity`` pieces, so its list is bounded.
    number = (F.col("round") * F.lit(1 << 40) + F.col("block") * F.lit(2 * BLOCK) + F.col("bin")) * 2
    placed = bins.groupBy(number.alias("sequence_id")).agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("own")).select(
        "sequence_id", "own", F.posexplode("own").alias("i", "one")).select(
        F.col("one.key").alias("key"), "sequence_id",
        F.aggregate(F.slice("own", 1, F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset"))
    full = keyed.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("key") * 2 + 1, "offset": F.lit(0).cast("long")})
    return keyed.where(F.col("length") < capacity).join(placed, "key").select(full.columns).unionByName(full).drop("key")
