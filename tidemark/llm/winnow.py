"""Benchmark decontamination by winnowing (Schleimer et al. 2003), DataFrame operations only.

Of every ten consecutive words the smallest hash of a five-word gram is kept on both sides, so two texts that share ten words
share a kept hash. Kept hashes of documents are joined with those of the benchmark; around each hit the full windows of ten
words are compared as text. Benchmark texts of fewer than ten words are one window each: for every such length that occurs,
all grams of that length are kept, which is winnowing with a window of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import ascii_lower

WINDOW, GRAM = 10, 5


def words_of(text: Column) -> Column:
    """Words of ASCII digits, lower-cased A-Z and all characters beyond ASCII; none for a missing text."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1)
    return F.array_remove(parts, "")


def _grams(words: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words of an array column."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(words, i, size)))).otherwise(
        F.expr("cast(array() as array<bigint>)"))


def _marks(grams: str, span: int) -> Column:
    """Smallest hash of every ``span`` neighbours, each once; none if there are fewer."""
    last = F.size(grams) - span
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_min(
        F.slice(grams, i, span))))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _fingerprints(texts: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """``texts(key, words)`` to ``(key, length, mark)``, window lengths with the hashes kept for them."""
    marked = texts.withColumn("grams", _grams("words", gram))

    def labelled(hashes, length):
        return F.transform(hashes, lambda h: F.struct(F.lit(length).alias("length"), h.alias("mark")))
    kinds = [labelled(_marks("grams", window - gram + 1), window), *[labelled(F.array_distinct(_grams("words", n)), n) for n in short]]
    return marked.select("key", F.explode(F.concat(*kinds) if len(kinds) > 1 else kinds[0]).alias("f")).select("key", "f.length", "f.mark")


def _windows(words: str, starts: Column, size: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(size).alias("length"), F.array_join(
        F.slice(words, s + 1, size), " ").alias("window")))


def _starts(words: str, grams: str, marks: Column, window: int, gram: int) -> Column:
    """Starts of the windows that hold a gram with one of the ``marks``."""
    last = F.size(words) - window
    hit = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(marks, F.get(grams, i)))
    around = F.flatten(F.transform(hit, lambda p: F.sequence(F.greatest(p - (window - gram), F.lit(0)), p)))
    return F.when((last >= 0) & (F.size(marks) > 0), F.filter(F.array_distinct(around), lambda s: s <= last)).otherwise(
        F.expr("cast(array() as array<int>)"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items, contaminated)`` for each row of ``docs(doc_id, text)``.

    A document word inside any occurrence of a window of ``benchmark(item_id, text)`` is hit; ``items`` lists the items with
    such windows, sorted as strings. Missing and empty texts have no words; benchmark rows without an id are left out; rows
    that share a document id count as one document and get the same hits. No rows give no rows.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = materialize(items.where(F.size("words") > 0), "winnow-items")
    size = F.least(F.size("words"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda s: F.array_join(F.slice("words", s, size), " "))
    windows = items.select("item_id", size.alias("length"), F.explode(cut).alias("window")).groupBy("window", "length").agg(
        F.collect_set("item_id").alias("items"))
    windows = materialize(windows, "winnow-windows")
    # At most window - 1 values.
    short = [r["length"] for r in windows.where(F.col("length") < window).select("length").distinct().orderBy("length").head(window)]
    named = items.select(F.col("item_id").alias("key"), "words")
    marks = materialize(_fingerprints(named, window, gram, short).select("length", "mark").distinct(), "winnow-marks")

    texts = docs.select(F.col("doc_id").alias("key"), words_of(F.col("text")).alias("words"))
    hits = _fingerprints(texts, window, gram, short).join(marks, ["length", "mark"]).groupBy("key").agg(
        F.collect_set(F.struct("length", "mark")).alias("found"))
    hits = materialize(hits, "winnow-hits")
    near = docs.join(hits, docs["doc_id"].eqNullSafe(hits["key"])).select("key", "found", words_of(F.col("text")).alias("words"))
    near = near.withColumn("grams", _grams("words", gram))

    def marks_of(n):
        return F.transform(F.filter("found", lambda x: x["length"] == n), lambda x: x["mark"])
    spots = [_windows("words", _starts("words", "grams", F.col(f"m{window}"), window, gram), window)]
    near = near.withColumn(f"m{window}", marks_of(window))
    for n in short:
        near = near.withColumns({f"m{n}": marks_of(n), f"g{n}": _grams("words", n)})
        spots.append(_windows("words", _starts("words", f"g{n}", F.col(f"m{n}"), n, n), n))
    spots = near.select("key", F.explode(F.concat(*spots) if len(spots) > 1 else spots[0]).alias("w")).select("key", "w.*")
    met = spots.join(windows, ["window", "length"]).groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("at"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    met = materialize(met.select(
        "key", F.size(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))).cast(
            "long").alias("n_hit"), F.array_sort("items").alias("items")), "winnow-met")
    counted = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.expr("cast(array() as array<string>)")
    return counted.join(met, counted["doc_id"].eqNullSafe(met["key"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
