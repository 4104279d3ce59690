"""Substring dedup by sliding sentence spans: runs of consecutive sentences are hashed and joined globally.

A sentence of more than fifteen words is cut into units of at most eight at places that its words alone decide (winnowing): the
word with the lowest hash of each eight in a row begins one. A shorter sentence is one unit. A span starts, and one ends, at every
unit and takes two units, or more until it has twenty words, so a repeated passage of fifty words holds a whole span wherever it
stands. A text without a span is one as a whole. Of each span that occurs more than once the first occurrence, by document id and
place, stays; all units of the other occurrences are removed.

Texts are read once into a table of unit digests, about nine bytes a unit. From it spans are hashed twice: a first pass counts
hashes and keeps those seen more than once, a second one finds the places of these alone: text and number of the span in it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import row_key, unused

SENTENCES, WORDS = 2, 20
LONG, WINDOW = 15, 8
#: Characters of text, and units, that a Python worker handles at once; a longer text is handled alone.
CHARS, UNITS = 1 << 22, 1 << 18
CACHE = 500_000
#: Odd base of the hash of a sequence, a polynomial modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: Marks that end a sentence without white space after them: of Chinese, Japanese, Indic, Arabic, Ethiopic, Armenian, Burmese, Khmer, Tibetan.
MARKS = "。．｡！？।॥؟۔።፧։၊။។៕།༎"
ENDS = frozenset(MARKS)
#: A sentence ends after its marks and white space, or at the end of a line.
SENTENCE = re.compile(rf"[^.!?\n{MARKS}]*(?:[{MARKS}]+[.!?{MARKS}]*\s*|[.!?]+(?=\s|$)\s*|[.!?]+|\n\s*|$)")
#: Scripts without blanks between words: every character counts as one.
DENSE = "฀-໿ༀ-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
ONE = re.compile(rf"[{DENSE}]")
WORD = re.compile(rf"[{DENSE}]|[^\s{DENSE}]+")


def sentences(text: str) -> list[str]:
    """Pieces that join to the text again; marks inside a word (3.5) end no sentence."""
    pieces, held = [], ""
    for m in SENTENCE.finditer(text):
        held += m.group()
        if held and (held[-1].isspace() or m.end() == len(text) or m.group().rstrip(".!?")[-1:] in ENDS):
            pieces.append(held)
            held = ""
    return pieces


def words_of(pieces: list[str]) -> list[list[str]]:
    """The words of each piece in lower case; where no script is dense, they are what white space parts."""
    return [WORD.findall(p.lower()) if not p.isascii() and ONE.search(p) else p.lower().split() for p in pieces]


@lru_cache(maxsize=1)
def _known() -> dict[str, int]:
    return {}


def word_hashes(words: list[str]) -> np.ndarray:
    known = _known()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        new = set(words).difference(known)
    if len(known) + len(new) > CACHE:
        known.clear()
        new = set(words)
    known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in new)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def inner_cuts(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that begin a further unit inside a long sentence, and the sentence of each; sentences are given by first word and size."""
    long = np.flatnonzero(sizes > LONG)
    counts = sizes[long] - WINDOW + 1
    owner = np.repeat(long, counts)
    if not len(owner):
        return owner, owner
    windows = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    lowest = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[windows, ::-1].argmin(1)
    cuts, at = np.unique(windows + WINDOW - 1 - lowest, return_index=True)
    inside = cuts > starts[owner[at]]
    return cuts[inside], owner[at][inside]


def word_starts(piece: str, words: int) -> list[int]:
    parts, bare = piece.split(), piece.strip()
    if len(parts) == words and sum(map(len, parts)) + words - 1 == len(bare):  # single blanks everywhere
        return list(accumulate((len(w) + 1 for w in parts[:-1]), initial=len(piece) - len(piece.lstrip())))
    return [m.start() for m in WORD.finditer(piece)]


def units(text: str) -> list[tuple[str, list[str]]]:
    """Pieces that join to the text again, each with its words in lower case: short sentences, and parts of long ones."""
    pieces = sentences(text)
    words = words_of(pieces)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    cuts, owner = inner_cuts(word_hashes([w for own in words for w in own]), starts, sizes)
    inner: dict[int, list[int]] = {}
    for cut, k in zip(cuts.tolist(), owner.tolist()):
        inner.setdefault(k, []).append(cut - int(starts[k]))
    found = []
    for k, (piece, own) in enumerate(zip(pieces, words)):
        if k not in inner:
            found.append((piece, own))
            continue
        at = word_starts(piece, len(own))
        bounds = [0, *inner[k], len(own)]
        for lo, hi in zip(bounds, bounds[1:]):
            found.append((piece[at[lo] if lo else 0:at[hi] if hi < len(own) else len(piece)], own[lo:hi]))
    return found


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))


def sequence_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = BASE) -> np.ndarray:
    """A hash of each slice ``values[lo:hi]``: the same values in the same order give the same hash wherever they stand."""
    size = 1 << len(values).bit_length()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(base, size)[:len(values)])])
    x = (sums[hi] - sums[lo]) * _powers(pow(base, -1, 1 << 64), size)[lo]
    # All bits depend on all others, so that a sequence of sequences is told from one long sequence.
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def unit_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A digest and the number of words of each unit of all ``texts``, and the number of units of each text."""
    parts = [words_of(sentences(t)) for t in texts]
    sizes = np.array([len(w) for own in parts for w in own], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = word_hashes([w for own in parts for piece in own for w in piece])
    cuts, owner = inner_cuts(hashes, starts, sizes)
    lo = np.sort(np.concatenate([starts, cuts]), kind="stable").astype(np.int64)
    hi = np.append(lo[1:], len(hashes)).astype(np.int64)
    per_sentence = np.cumsum(np.concatenate([np.zeros(1, np.int64), 1 + np.bincount(owner, minlength=len(sizes))]))
    ends = np.cumsum([0, *map(len, parts)])
    return sequence_hashes(hashes, lo, hi), (hi - lo), np.diff(per_sentence[ends])


def span_places(counts: np.ndarray, sizes: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, first unit, end)`` of every span; ``counts`` are the words of the units of all texts, ``sizes`` the units of each."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts, dtype=np.int64)])
    last = np.cumsum(sizes)
    first = last - sizes
    i = np.arange(len(counts))
    text = np.repeat(np.arange(len(sizes)), sizes)
    # The shortest span that starts at a unit, and the shortest that ends with it.
    end = np.maximum(i + least, np.searchsorted(total, total[:-1] + words, "left"))
    start = np.minimum(i + 1 - least, np.searchsorted(total, total[1:] - words, "right") - 1)
    ahead, behind = end <= last[text], start >= first[text]
    own = np.concatenate([i[ahead], start[behind]])
    until = np.concatenate([end[ahead], i[behind] + 1])
    whose = np.concatenate([text[ahead], text[behind]])
    alone = np.setdiff1d(np.flatnonzero(total[last] > total[first]), whose)
    places = np.unique(np.concatenate([own, first[alone]]) * (len(counts) + 1) + np.concatenate([until, last[alone]]))
    own, until = places // (len(counts) + 1), places % (len(counts) + 1)
    return text[own], own, until


def unit_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, id, n, digests, words)`` for each row of ``docs(doc_id, text)``: row key, number of the row and of its units."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            at = 0
            while at < len(texts):
                to, chars = at + 1, len(texts[at])
                while to < len(texts) and chars + len(texts[to]) <= CHARS:
                    chars += len(texts[to])
                    to += 1
                digests, words, sizes = unit_digests(texts[at:to])
                ends = np.cumsum(sizes)
                cut = lambda x, width: pa.array([x[(e - n) * width:e * width] for e, n in zip(ends.tolist(), sizes.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, to - at) for c in batch.columns[:3]], pa.array(sizes, pa.int64()),
                     cut(digests.astype("<u8").tobytes(), 8), cut(words.astype("u1").tobytes(), 1)], ["doc_id", "row", "id", "n", "digests", "words"])
                at = to

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key().alias("row"), F.monotonically_increasing_id().alias("id"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, row long, id long, n long, digests binary, words binary")


def spans(units_: DataFrame, least: int, words: int, places: bool) -> DataFrame:
    """``(span)``, the hash of each span of a unit table, with ``places`` ``(span, id, at)``: the row, and number of the span in it."""
    def run(batches):
        for batch in batches:
            bound = np.cumsum(batch.column(1).to_numpy()) // UNITS
            cuts = [0, *(np.flatnonzero(np.diff(bound)) + 1).tolist(), len(bound)]
            for lo, hi in zip(cuts, cuts[1:]):
                part = batch.slice(lo, hi - lo)
                digests = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u8")
                counts = np.frombuffer(b"".join(part.column(3).to_pylist()), "u1")
                text, a, b = span_places(counts, part.column(1).to_numpy(), least, words)
                columns = [pa.array(sequence_hashes(digests, a, b).view(np.int64))]
                if places:
                    number = np.arange(len(text)) - np.searchsorted(text, text)
                    columns += [part.column(0).take(pa.array(text)), pa.array(number, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["span", "id", "at"][:len(columns)])

    return units_.select("id", "n", "digests", "words").mapInArrow(run, "span long, id long, at int" if places else "span long")


def drop_repeats(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """``docs`` with ``text`` freed of repeated spans, and ``n_sentences``, ``n_removed`` and ``first_docs``.

    Both numbers count units: sentences, and the parts of long ones.
    ``first_docs`` lists the documents (at most all it shares spans with) that keep the removed text. A missing text stays
    missing, a text with nothing left is empty. Rows are told apart by id and text: repeated rows keep or lose the
    same sentences, texts that share an id, or have none, are cut each by itself. No rows give no rows. Texts of any length are cut whole.
    Columns of the added names are replaced, all others stay as they are, whatever their names.
    """
    kept = docs.drop("n_sentences", "n_removed", "first_docs")
    table = materialize(unit_table(kept), "spans-units")
    # The count combines before the shuffle, so a frequent span is one row a task.
    twice = materialize(spans(table, least, words, False).groupBy("span").count().where("count > 1").select("span"), "spans-twice")
    # Repeated spans grow with the corpus, so they are not broadcast; a span that holds many rows is split by the join.
    again = spans(table, least, words, True).join(twice.hint("merge"), "span", "left_semi")
    again = materialize(again.join(table.select("id", "doc_id", "row"), "id").drop("id"), "spans-again")
    place = F.struct("doc_id", "row", "at")
    first = again.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written, so that the join stands between two shuffles of its own and a span that holds many rows is split there as well.
    first = materialize(first.where(~F.col("first").eqNullSafe(F.col("last"))).select("span", "first"), "spans-first")
    later = again.join(first, "span").where(~F.col("first").eqNullSafe(place))
    found = table.select("row", "n").unionByName(
        later.select("row", F.col("at").alias("gone"), F.struct(F.col("first.doc_id").alias("doc_id")).alias("by")), allowMissingColumns=True)
    # Neither set takes the missing entries of a text's own row; a missing id of a first document is left out as well.
    marks = materialize(found.groupBy("row").agg(F.max("n").alias("n"), F.collect_set("gone").alias("gone"), F.collect_set("by.doc_id").alias("docs")), "spans-gone")
    key, mark = unused(kept, "key"), unused(kept, "mark")
    joined = kept.withColumn(key, row_key()).join(marks.select(
        F.col("row").alias(key), F.struct("n", "gone", F.when(F.size("gone") > 0, F.array_sort("docs")).alias("docs")).alias(mark)), key, "left").drop(key)
    joined = joined.select(*[F.col(f"`{c}`") for c in kept.columns], F.col(f"{mark}.docs").alias("first_docs"), mark)
    at, last = kept.columns.index("text"), len(joined.columns) - 1

    def run(batches):
        for batch in batches:
            texts, removed = [], []
            own = batch.column(last)
            for text, gone in zip(batch.column(at), own.field("gone")):
                text, numbers, lost = text.as_py(), gone.as_py(), set()
                if numbers:
                    parts = units(text)
                    _, start, end = span_places(np.array([len(w) for _, w in parts]), np.array([len(parts)]), least, words)
                    lost.update(*map(range, start[numbers].tolist(), end[numbers].tolist()))
                    text = "".join(p for i, (p, _) in enumerate(parts) if i not in lost)
                texts.append(text)
                removed.append(len(lost))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:last])]
            yield pa.RecordBatch.from_arrays([*columns, own.field("n"), pa.array(removed, pa.int64())], [*batch.schema.names[:last], "n_sentences", "n_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:last])
    return joined.mapInArrow(run, f"{fields}, n_sentences long, n_removed long")
