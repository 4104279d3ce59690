"""Token counts by a whole-token shortcut for byte-level merge vocabularies.

A text falls into pre-tokens whose merges don't depend on each other. Which vocabulary strings encode alone as one token is
proved once, without any text, by encoding the whole vocabulary. A pre-token that is such a string counts one without merging;
only the rest is merged, each distinct one once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which byte-level vocabularies of this kind split texts.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# Ranges of code points that the pattern above and the tokenizer's own, made for another version of Unicode, class
# alike (a test goes through all of them). Texts with others are encoded by the tokenizer.
ALIKE = [(0x0, 0x4FF), (0x600, 0x7FF), (0x900, 0xBFF), (0xD00, 0x207F), (0x20A0, 0xA6FF), (0xA800, 0xAAFF), (0xAC00, 0xD7FF),
         (0xE000, 0x106FF), (0x1E700, 0x2B6FF)]
UNLIKE = regex.compile("[^%s]" % "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ALIKE))
#: Pre-tokens held before they are counted, and characters of merged pre-tokens that a worker keeps.
HELD, CACHE = 1 << 18, 1 << 25


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    told = json.loads(tokenizer.to_str())
    before = told["pre_tokenizer"] or {}
    plain = (told["model"]["type"] == "BPE" and not told["model"]["dropout"] and not told["normalizer"] and not told["truncation"]
             and not told["padding"] and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
             and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]))
    if not plain:
        raise ValueError("the shortcut is proved for byte-level merge vocabularies without a normaliser only")
    return tokenizer, [t["content"] for t in told["added_tokens"]]


def whole_tokens(tokenizer, added: list[str]) -> set[str]:
    """Vocabulary strings that encode alone as their own one token, hence are one pre-token and merge to the end.

    Tokens that are no whole characters decode to something else and drop out, as do added tokens, which are found before the split.
    """
    ids = sorted(tokenizer.get_vocab(with_added_tokens=False).values())
    strings = tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
    alone = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return {s for i, s, e in zip(ids, strings, alone) if e.ids == [i]}.difference(added)


class TokenCounter:
    """Numbers of tokens of texts; merged pre-tokens are kept up to ``CACHE`` characters, which affects time only."""

    def __init__(self, path: str):
        self.tokenizer, added = load(path)
        self.whole = whole_tokens(self.tokenizer, added)
        self.sizes = dict.fromkeys(self.whole, 1)
        self.cached = 0
        longest_first = sorted(filter(None, added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")

    def _merge(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, seen: set[str]) -> None:
        rest = seen.difference(self.sizes)
        new = sum(map(len, rest))
        if self.cached + new > CACHE:
            self.sizes, self.cached = dict.fromkeys(self.whole, 1), 0
            rest = seen.difference(self.sizes)
            new = sum(map(len, rest))
        self.cached += new
        rest = iter(rest)
        while some := list(islice(rest, 8192)):
            self.sizes.update(zip(some, self._merge(some)))

    def _parts(self, text: str) -> Iterator[int | list[str]]:
        """Numbers of tokens already known, and lists of pre-tokens."""
        at = 0
        for piece in self.added.splititer(text):
            at += 1
            if not piece:
                continue
            if UNLIKE.search(piece):
                yield self._merge([piece])[0]
            elif len(piece) <= HELD:
                yield PATTERN.findall(piece)
            else:
                found = PATTERN.finditer(piece)
                while words := [m.group() for m in islice(found, HELD)]:
                    yield words
        yield at - 1

    def counts(self, texts: list[str]) -> list[int]:
        out, held, size = [0] * len(texts), [], 0

        def flush():
            self._learn(set().union(*[words for _, words in held]))
            for i, words in held:
                out[i] += sum(map(self.sizes.__getitem__, words))
            held.clear()

        for i, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    out[i] += part
                    continue
                held.append((i, part))
                size += len(part)
                if size >= HELD:
                    flush()
                    size = 0
        flush()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs(doc_id, text)``.

    ``tokenizer`` is a file of the tokenizers library; counts are those of its own encoding, without added begin or end, and special
    strings inside texts are one token each. A missing text is empty and has no token; rows are never merged, whatever their ids;
    no rows give no rows; very long texts are read as a stream of pre-tokens; other columns, whatever their names, are left out.
    """
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        known = counter(tokenizer)
        out = []
        for lo in range(0, len(texts), 512):
            out += known.counts(texts.slice(lo, 512).to_pylist())
        return pa.array(out, pa.int64())

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
