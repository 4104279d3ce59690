"""Fuzzy line dedup by MinHash over character shingles.

Signatures of all lines give band keys; lines that share a key are candidates; candidates are verified by the exact Jaccard
similarity of their shingle sets; distributed union-find joins what is linked, and one line of each component stays.

Candidates are verified in two rounds. First each line goes, once, to the smallest line it shares a key with, which settles
whole groups of variants. Then only keys whose lines are still in different components are looked at in full. A group is cut
into blocks that all meet pairwise if it is large, and gives spanning links, never all pairs. Small groups are compared many at a time.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import row_key, spread
from .components import components

SHINGLE, BANDS, ROWS, SIMILARITY = 6, 12, 5, 0.8
LANE, LANES = 128, 8192
BLOCK = 4096
FEW = 64
CHARS, MET_CHARS = 1 << 20, 1 << 18
BUCKETS, KEYS = 1024, 1 << 19
BLANKS = " \t\r\f\v\0"

_draws = np.random.default_rng(11)
FACTORS = _draws.integers(1, 1 << 32, (BANDS * ROWS, 1), np.uint32) | np.uint32(1)
FACTOR = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def shingles(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of all lines in a row, and how many each line has; a short line is one shingle."""
    texts = [x.lower().ljust(size, "\0") for x in lines]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(codes):
        return np.zeros(0, np.uint64), lengths
    # Polynomial hashes of ``width`` characters, doubled along the binary digits of ``size``.
    hashes, width = codes, 1
    for digit in f"{size:b}"[1:]:
        hashes, tail = hashes[:-width] * np.uint64(pow(FACTOR, width, 1 << 64)), hashes[width:]
        hashes += tail
        width *= 2
        if digit == "1":
            hashes = hashes[:-1] * np.uint64(FACTOR)
            hashes += codes[width:]
            width += 1
    ends = np.cumsum(lengths)
    kept = np.ones(len(hashes), bool)
    for j in range(1, size):
        cut = ends[:-1] - j
        kept[cut] = False
    return mixed(hashes[kept]), lengths - size + 1


def signatures(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """MinHash values, one row per line. One vector step adds the next shingle of many lines to all their minima."""
    hashes, counts = shingles(lines, size)
    pieces = -(-counts // LANE)
    owner = np.repeat(np.arange(len(lines)), pieces)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * LANE
    at = (np.cumsum(counts) - counts)[owner] + within
    sizes = np.minimum(LANE, counts[owner] - within)
    flat = np.concatenate([(hashes >> np.uint64(32)).astype(np.uint32), np.zeros(LANE, np.uint32)])
    lows = np.zeros((len(owner), len(FACTORS)), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), LANES):
        lanes = order[lo:lo + LANES]
        longest = int(sizes[lanes[0]])
        block = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, longest)[at[lanes]].T)
        active = np.searchsorted(-sizes[lanes], -np.arange(longest), side="left")
        low = np.full((len(FACTORS), len(lanes)), 0xFFFFFFFF, np.uint32)
        room = np.empty_like(low)
        for t in range(longest):
            n = active[t]
            own = room[:, :n]
            np.multiply(block[t, :n], FACTORS, out=own)
            np.minimum(low[:, :n], own, out=low[:, :n])
        lows[lanes] = low.T
    return np.minimum.reduceat(lows, np.cumsum(pieces) - pieces, axis=0) if len(lines) else lows


def band_keys(signed: np.ndarray) -> np.ndarray:
    """One 64-bit key per line and band."""
    keys = np.empty((len(signed), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signed), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * np.uint64(FACTOR) + signed[:, b * ROWS + r].astype(np.uint64))
        keys[:, b] = key
    return keys.view(np.int64)


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, pos, id, line)`` for every line that isn't blank; ``id`` is the hash of the line without outer blanks."""
    rows = docs.select("doc_id", row_key().alias("row"), F.split("text", "\n", -1).alias("lines")).select("doc_id", "row", F.posexplode("lines").alias("pos", "line"))
    # Trimming by a list of characters is dear, so only lines that need it are trimmed.
    edged = reduce(or_, [f("line", F.lit(x)) for x in BLANKS for f in (F.startswith, F.endswith)])
    rows = rows.withColumn("line", F.when(edged, F.trim("line", F.lit(BLANKS))).otherwise(F.col("line"))).where("line <> ''")
    return rows.select("doc_id", "row", "pos", F.xxhash64("line").alias("id"), "line")


def _banded(lines: DataFrame) -> DataFrame:
    """``(bucket, keys, ids)``: the band keys of many lines and the lines' ids, 8 bytes each; one row per range of keys, so that few are shuffled."""
    buckets = max(BUCKETS, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def rows(keys, ids):
        keys, ids = np.concatenate(keys).view(np.uint64), np.concatenate(ids)
        order = np.argsort(keys)
        keys, ids = keys[order], ids[order]
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = pa.py_buffer(np.append(starts, len(keys)).astype(np.int32) * np.int32(8))
        packed = [pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(x)]) for x in (keys, ids)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *packed], ["bucket", "keys", "ids"])

    def run(batches):
        keys, owners, waiting = [], [], 0
        for batch in batches:
            ids, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first)).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, held = lo, 0
                while hi < len(texts) and held < CHARS:
                    held += len(texts[hi])
                    hi += 1
                keys.append(band_keys(signatures(texts[lo:hi])).ravel())
                owners.append(np.repeat(ids[lo:hi], BANDS))
                waiting += len(keys[-1])
                lo = hi
                if waiting > KEYS:
                    yield rows(keys, owners)
                    keys, owners, waiting = [], [], 0
        if waiting:
            yield rows(keys, owners)

    return lines.select("id", "line").mapInArrow(run, "bucket int, keys binary, ids binary")


def _crowded(banded: DataFrame, most: int = KEYS) -> DataFrame:
    """Distinct rows of ``(key, id)`` whose key has another id, from ``banded(bucket, keys, ids)``.

    A bucket is merged ``most`` entries at a time; of what is merged one id per key is held, whatever a key's size.
    """
    def merge(held, keys, ids):
        """What is held now, and the rows found: ids that differ from the held one of their key, and that one at first."""
        keys, ids = (np.concatenate([x, *y]) for x, y in zip(held, (keys, ids)))
        order = np.argsort(keys, kind="stable")  # the held id stays first of its key
        told = np.zeros(len(keys), bool)
        told[:len(held[2])] = held[2]
        keys, ids, told = keys[order], ids[order], told[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        other = ids != np.repeat(ids[first], np.diff(np.append(first, len(keys))))
        crowd = np.logical_or.reduceat(other, first)
        other[first] = crowd & ~told[first]
        return (keys[first], ids[first], told[first] | crowd), pa.RecordBatch.from_arrays([pa.array(keys[other]), pa.array(ids[other])], ["key", "id"])

    def run(batches):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        bucket, held, keys, ids, waiting = None, none, [], [], 0
        for batch in batches:
            for own, *packed in zip(*batch.columns):
                own = own.as_py()
                if waiting and (own != bucket or waiting > most):
                    held, found = merge(held, keys, ids)
                    yield found
                    keys, ids, waiting = [], [], 0
                if own != bucket:
                    bucket, held = own, none
                for to, x in zip((keys, ids), packed):
                    to.append(np.frombuffer(x.as_buffer(), np.int64))
                waiting += len(keys[-1])
        if waiting:
            yield merge(held, keys, ids)[1]

    return spread(banded, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, id long").repartition("key", "id").distinct()


def _with_company(rows: DataFrame) -> DataFrame:
    """Distinct rows of ``(key, id)`` whose key has another id. Rows come sorted, so one row is held, whatever a key's size."""
    def run(batches):
        last = None  # key and id of the row at the end, and whether it already has company
        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            company = False
            if last:
                keys, ids, company = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], ids]), last[2]
            if not len(keys):
                continue
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            keys, ids = keys[new], ids[new]
            same = keys[1:] == keys[:-1]
            out = np.concatenate([[company], same]) | np.concatenate([same, [False]])
            last = (keys[-1], ids[-1], bool(out[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1][out[:-1]]), pa.array(ids[:-1][out[:-1]])], ["key", "id"])
        if last and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["key", "id"])

    return spread(rows, "key").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long")


def _large_links(ids: list[int], lines: list[str], roots: list[int], least: float) -> list[tuple[int, int]]:
    """``similar_links`` of one group: a line that reaches others leaves only the rest to compare, with all of their root."""
    hashes, counts = shingles(lines)
    owner = np.repeat(np.arange(len(lines)), counts)
    # Ranks of distinct shingles, each once per line.
    ranks = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    both = np.sort(owner * (ranks.max() + 1) + ranks)
    owner, ranks = np.divmod(both[np.concatenate([[True], both[1:] != both[:-1]])], ranks.max() + 1)
    sizes = np.bincount(owner, minlength=len(lines))
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(ranks.max() + 1, bool)
    _, roots = np.unique(np.array(roots, np.int64), return_inverse=True)
    links, waiting = [], np.arange(len(lines))
    live_ranks, live_owner = ranks, owner
    front = []
    while front or len(waiting):
        if not front:
            entered = roots == roots[waiting[0]]
        else:
            at = front.pop()
            own = ranks[starts[at]:starts[at] + sizes[at]]
            marked[own] = True
            common = np.bincount(live_owner[marked[live_ranks]], minlength=len(lines))[waiting]
            marked[own] = False
            reached = waiting[common >= least * (sizes[waiting] + sizes[at] - common) - 1e-9]
            if not len(reached):
                continue
            reached = reached[np.unique(roots[reached], return_index=True)[1]]
            links += [(ids[at], ids[x]) for x in reached]
            entered = np.isin(roots, roots[reached])
        front += np.flatnonzero(entered).tolist()
        waiting = waiting[~entered[waiting]]
        if not len(waiting):
            break
        left = np.zeros(len(lines), bool)
        left[waiting] = True
        kept = left[live_owner]
        live_ranks, live_owner = live_ranks[kept], live_owner[kept]
    return links


def similar_links(groups: list[int], ids: list[int], lines: list[str], roots: list[int], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what exact Jaccard similarity connects within groups of so many lines; lines of a root are connected already."""
    if max(groups, default=0) > FEW:
        links, ends, few = [], np.cumsum(groups).tolist(), []
        for n, e in zip(groups, ends):
            if n > FEW:
                links += _large_links(ids[e - n:e], lines[e - n:e], roots[e - n:e], least)
            else:
                few.append((n, e))
        own = [i for n, e in few for i in range(e - n, e)]
        return links + similar_links([n for n, _ in few], *[[x[i] for i in own] for x in (ids, lines, roots)], least)
    if not groups:
        return []
    ends = np.cumsum(groups)
    n = np.array(groups)
    first = ends - n
    group = np.repeat(np.arange(len(n)), n)
    hashes, counts = shingles(lines)
    # Shingles sorted within their group, the line's place in the group in the last bits.
    codes = hashes & np.uint64(0xFFFFFFFFFFFFFFFF ^ (FEW - 1))
    codes |= np.repeat((np.arange(len(lines)) - first[group]).astype(np.uint64), counts)
    held = np.add.reduceat(counts, first)
    lo = 0
    for hi in np.cumsum(held).tolist():
        codes[lo:hi].sort()
        lo = hi
    group = np.repeat(np.arange(len(n)), held)
    change = group[1:] != group[:-1]
    new = np.concatenate([[True], (codes[1:] != codes[:-1]) | change])
    codes, group = codes[new], group[new]
    place = (codes & np.uint64(FEW - 1)).astype(np.int64)
    sizes = np.bincount(first[group] + place, minlength=len(lines))
    codes >>= np.uint64(FEW.bit_length() - 1)
    run = np.cumsum(np.concatenate([[False], (codes[1:] != codes[:-1]) | (group[1:] != group[:-1])]))
    # Lines that hold the same shingle stand side by side: pairs of them 1, 2, ... apart.
    squares = np.cumsum(n * n) - n * n
    row = squares[group] + place * n[group]
    common = np.zeros(int((n * n).sum()), np.int64)
    at, apart = np.arange(len(run)), 0
    while len(at):
        apart += 1
        at = at[:np.searchsorted(at, len(run) - apart)]
        at = at[run[at] == run[at + apart]]
        common += np.bincount(row[at] + place[at + apart], minlength=len(common))
    pairs = np.flatnonzero(common)
    own = np.searchsorted(squares, pairs, side="right") - 1
    a, b = np.divmod(pairs - squares[own], n[own])
    a, b, common = a + first[own], b + first[own], common[pairs]
    near = common >= least * (sizes[a] + sizes[b] - common) - 1e-9
    links, seen, up = [], {}, list(range(len(lines)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, x in enumerate(zip(np.repeat(np.arange(len(n)), n).tolist(), roots)):
        up[i] = seen.setdefault(x, i)
    for x, y in zip(a[near].tolist(), b[near].tolist()):
        x_top, y_top = top(x), top(y)
        if x_top != y_top:
            up[y_top] = x_top
            links.append((ids[x], ids[y]))
    return links


def _verified(groups: DataFrame, texts: DataFrame, least: float, block: int, similar=similar_links, chars: int | None = None,
              settled: DataFrame | None = None) -> DataFrame:
    """``(a, b)`` links inside groups ``(gid, id)``; of a group above ``block`` lines, or ``chars`` characters, all pairs of blocks meet.

    What has the same root in ``settled(node, root)`` is not compared again.
    """
    if chars:
        held = groups.join(texts.select("id", F.length("line").cast("long").alias("held")), "id")
        sizes = held.groupBy("gid").agg(F.count("*").alias("n"), F.sum("held").alias("held")).where("n > 1")
        sizes = sizes.select("gid", F.greatest("n", F.ceil(F.col("held") * block / chars)).alias("n"))
    else:
        sizes = groups.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")
    cut = groups.join(sizes, "gid").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    cut = cut.withColumn("own", own).select("id", F.col("gid"), "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    parts = cut.select("id", F.xxhash64("gid", F.least("own", "other"), F.greatest("own", "other")).alias("part")).distinct()

    if settled is None:
        parts = parts.withColumn("root", F.col("id"))
    else:
        parts = parts.join(settled.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))

    def run(batches):
        part, held, squares = None, 0, 0
        groups, ids, lines, roots = [], [], [], []

        def found():
            links = similar(groups, ids, lines, roots, least)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in links], pa.int64()), pa.array([r[1] for r in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for key, id_, root, line in zip(*[c.to_pylist() for c in batch.columns]):
                if key != part:
                    if held > MET_CHARS or squares > MET_CHARS:
                        yield found()
                        held, squares, groups, ids, lines, roots = 0, 0, [], [], [], []
                    part = key
                    groups.append(0)
                groups[-1] += 1
                held += len(line)
                squares += 2 * groups[-1]
                ids.append(id_)
                lines.append(line)
                roots.append(root)
        yield found()

    dealt = spread(parts.join(texts, "id").select("part", "id", "root", "line"), "part").sortWithinPartitions("part", "id")
    return dealt.mapInArrow(run, "a long, b long").repartition("a", "b")


def line_groups(lines: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(node, root)`` for the ids of ``lines(id, line)`` that are similar to a different line."""
    crowded = materialize(_crowded(_banded(lines)), "lines-crowded")
    texts = materialize(lines.select("id", "line").join(crowded.select("id").distinct(), "id", "left_semi").distinct(), "lines-texts")
    return linked(crowded, texts, least, None, similar_links, "lines", block)


def linked(crowded: DataFrame, texts: DataFrame, least: float, chars: int | None, similar, name: str, block: int = BLOCK,
           known: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` of what ``similar`` links among the ids of ``texts(id, line)`` that share a key of ``crowded(key, id)``.

    ``known`` links ``(a, b)`` join in. Groups are written before they are verified: the driver plans, and plans again after every stage,
    what is read several times, so one plan of all steps would cost it more memory than the groups cost disk.
    """
    lows = crowded.groupBy("key").agg(F.min("id").alias("low"))
    nearest = crowded.join(lows, "key").groupBy("id").agg(F.min("low").alias("gid"))
    clusters = materialize(nearest.select("gid", F.explode(F.array("id", "gid")).alias("id")).distinct(), f"{name}-clusters")
    first = _verified(clusters, texts, least, block, similar, chars)
    settled = materialize(components(first if known is None else first.unionByName(known), f"{name}-first"), f"{name}-settled")
    rooted = crowded.join(settled, crowded["id"] == settled["node"], "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    # Keys of the same lines get the same group, which is verified once.
    same = F.xxhash64(F.bit_xor(F.xxhash64("id")), F.min("id"), F.max("id"), F.count("*")).alias("gid")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), same).where("lo < hi").select("key", "gid")
    rest = materialize(crowded.join(open_keys, "key").select("gid", "id").distinct(), f"{name}-rest")
    second = _verified(rest, texts, least, block, similar, chars, settled)
    return components(settled.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second), name)


def removals(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``(key, gone, kept_in)`` per row key that loses lines: their places, and the documents that keep the like."""
    lines = lines_of(docs)
    places = materialize(lines.select("doc_id", "row", "pos", "id"), "lines-places")
    groups = materialize(line_groups(lines, least, block), "lines-groups")
    # Only lines that stand in several places or in a group matter from here.
    several = places.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    rooted = materialize(several.join(groups.withColumnRenamed("node", "id"), "id", "full").select(
        "id", F.coalesce("root", "id").alias("root")), "lines-rooted")
    met = materialize(places.join(rooted, "id").select("root", "row", F.struct("doc_id", "row", "pos").alias("place")), "lines-met")
    first = met.groupBy("root").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("root", "first")
    gone = met.join(first, "root").where(~F.col("first").eqNullSafe(F.col("place")))
    return materialize(gone.groupBy(F.col("row").alias("key")).agg(
        F.collect_set("place.pos").alias("gone"), F.array_sort(F.collect_set("first.doc_id")).alias("kept_in")), "lines-gone")


def without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the places ``gone``; places become a map, so long texts take one look-up a line."""
    marked = F.map_from_arrays(gone, F.transform(gone, lambda p: F.lit(True)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: F.element_at(
        marked, i).isNull()), "\n"))


def drop_similar_lines(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``text`` freed of lines that repeat or resemble an earlier one, and ``n_lines``, ``n_removed``, ``kept_in``.

    Lines are compared without outer blanks, similarity ignores case; blank lines always stay. The line kept of a component is
    the first by document id and place; ``kept_in`` lists the documents that keep what this one loses. Lines of fewer than six
    characters match equal ones only. A missing text stays missing, a text that loses all is empty. Rows are
    told apart by id and text: repeated rows keep or lose the same places, texts that share an id, or have none, are cut each by
    itself, the first being the one with the smallest hash. No rows give no rows; columns of the added names are replaced.
    """
    kept = docs.drop("n_lines", "n_removed", "kept_in")
    gone = removals(kept, least, block)
    joined = kept.withColumn("key", row_key()).join(gone, "key", "left")
    names = [without(F.col("text"), F.col("gone")).alias("text") if n == "text" else F.col(f"`{n}`") for n in kept.columns]
    return joined.select(
        *names, F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("kept_in", F.expr(f"cast(array() as array<{kept.schema['doc_id'].dataType.simpleString()}>)")).alias("kept_in"))
