"""Fill-in-middle transformation with a sparse index of the characters that are not one byte long.

Texts are cut where hashes of their ids say, counted in units (runs of ASCII letters, or single characters) or in code points.
A text's bytes are its code points but for the multibyte characters, so only these are recorded: their byte positions and the
excess bytes up to each. A cut is converted between bytes and code points by a binary search in that index and one addition;
ASCII spans need no entry. Python sees texts and returns five numbers a row; Spark puts the parts together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUTS = T.StructType([T.StructField(name, T.LongType()) for name in ("n", "prefix_bytes", "middle_bytes", "prefix_chars", "middle_chars")])
#: Bytes looked at at once when units are counted.
STEP = 1 << 20
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


class Exceptions:
    """Where the multibyte characters of some UTF-8 bytes begin, and how many bytes they have beyond one."""

    def __init__(self, data: np.ndarray):
        found = [lo + np.flatnonzero(data[lo:lo + STEP] >= 0xC0) for lo in range(0, len(data), STEP)]
        self.at = np.concatenate(found, dtype=np.int64, casting="unsafe") if found else np.zeros(0, np.int64)
        lead = data[self.at]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0))])

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte positions ``at``, each of which begins a character or ends the bytes."""
        return at - self.excess[np.searchsorted(self.at, at)]

    def bytes(self, chars: np.ndarray) -> np.ndarray:
        """Byte positions of the code points numbered ``chars``."""
        return chars + self.excess[np.searchsorted(self.at - self.excess[:-1], chars)]


class Units:
    """Starts of the units of texts that lie one after another in ``data``, found block by block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        ends, base = [np.zeros(1, np.int64)], 0
        self.before = np.zeros(len(offsets), np.int64)
        for lo in range(0, len(data), STEP):
            starts = self._starts(lo)
            inside = slice(*np.searchsorted(offsets, [lo, lo + STEP]))
            self.before[inside] = base + np.searchsorted(starts, offsets[inside])
            base += len(starts)
            ends.append(np.array([base]))
        self.before[np.searchsorted(offsets, len(data)):] = base
        self.ends = np.concatenate(ends)

    def _starts(self, lo: int) -> np.ndarray:
        block = self.data[lo:lo + STEP]
        letter = LETTER[block]
        follows = np.empty_like(letter)
        follows[1:] = letter[:-1]
        follows[0] = lo > 0 and LETTER[self.data[lo - 1]]
        starts = ((block & 0xC0) != 0x80) & ~(letter & follows)
        own = self.offsets[slice(*np.searchsorted(self.offsets, [lo, lo + len(block)]))]
        starts[own - lo] = True
        return lo + np.flatnonzero(starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.before)

    def bytes(self, numbers: np.ndarray) -> np.ndarray:
        """Byte positions of the units numbered ``numbers`` over all texts; the number of all units is the end."""
        out = np.full(len(numbers), len(self.data), np.int64)
        block = np.searchsorted(self.ends, numbers, side="right") - 1
        for b in np.unique(block[numbers < self.ends[-1]]).tolist():
            mine = block == b
            out[mine] = self._starts(b * STEP)[numbers[mine] - self.ends[b]]
        return out


def _cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str) -> list[np.ndarray]:
    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    index = Exceptions(data)
    if unit == "char":
        before, locate = index.chars(offsets), index.bytes
        n = np.diff(before)
    else:
        units = Units(data, offsets)
        before, n, locate = units.before, units.counts(), units.bytes
    a, b = first % (n + 1), second % (n + 1)
    ends = []
    for cut in (np.minimum(a, b), np.maximum(a, b)):
        # The end of a text is its own offset: the next unit may begin behind empty texts.
        ends.append(np.where(cut < n, locate(before[:-1] + np.minimum(cut, np.maximum(n - 1, 0))), offsets[1:]))
    low, high = ends
    at = [index.chars(x) for x in (offsets[:-1], low, high)]
    return [n, low - offsets[:-1], high - low, at[1] - at[0], at[2] - at[1]]


def cuts(text: Column, first: Column, second: Column, unit: str = "word") -> Column:
    """Struct of the number of units and the lengths of prefix and middle, in bytes and in code points.

    The prefix ends after the smaller of ``first % (n + 1)`` and ``second % (n + 1)`` units, the middle after the larger. A unit is
    a run of ASCII letters or any other single character (``word``), or a code point (``char``). None of the arguments may be null.
    """
    @F.arrow_udf(CUTS)
    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        columns = _cuts(texts, np.asarray(first, np.int64), np.asarray(second, np.int64), unit)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], CUTS.names)

    return cut(text, first, second)


def _group(doc_id: Column, seed: str, k: int) -> Column:
    """The k-th group of eight hex digits of the SHA-256 of seed, colon and id, as a number."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, unit: str = "word") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs(doc_id, text)``.

    Hashes of seed and id choose the cuts and the form: ``psm`` is prefix, suffix, middle with a mark before each, ``spm`` suffix,
    prefix, middle, ``plain`` the text as it is, which also empty texts and texts that hold a mark stay. ``plain`` has null lengths.
    A missing text is empty, a missing id hashes as an empty one; rows that share an id are cut by the same hashes, repeated rows
    stay; no rows give no rows; very long texts are looked at in blocks; other columns, whatever their names, are left out.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[_group(F.col("doc_id"), seed, k).alias(f"h{k + 1}") for k in range(4)])
    rows = rows.withColumn("cut", cuts(F.col("text"), F.col("h1"), F.col("h2"), unit))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.col("text").contains(mark)
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= plain_from), "plain").when(
        F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    raw, low, mid = F.col("text").cast("binary"), F.col("cut.prefix_bytes").cast("int"), F.col("cut.middle_bytes").cast("int")

    def part(mark, start, length):
        return F.concat(F.lit(mark).cast("binary"), F.substring(raw, start + 1, length))
    prefix, middle = part(PREFIX, F.lit(0), low), part(MIDDLE, low, mid)
    suffix = part(SUFFIX, low + mid, F.octet_length("text"))
    output = F.when(F.col("form") == "plain", raw).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(
        F.concat(suffix, prefix, middle)).cast("string")
    return rows.withColumn("form", form).select("doc_id", "cut.n", "form", *[
        F.when(F.col("form") != "plain", F.col(f"cut.{c}")).alias(c) for c in ("prefix_chars", "middle_chars")], output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that `fill_in_middle` made ``output`` of, from output and form alone. Marks can't arise where parts meet them."""
    psm = F.regexp_replace(output, f"(?s)^{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """``made`` with digests in place of the texts."""
    def sha(text):
        return F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
