"""Language identification by cross-parsing entropy (Ziv and Merhav 1993) with suffix automata of labelled text.

Per language a suffix automaton is built over a bounded sample of labelled text. A text is parsed from left to right into the
longest phrases that occur in that sample; the language that needs fewest phrases, normalised by length, wins. Every letter of
the samples has a code of its own. The transitions of all automata share one array: a state is placed where its letters find free
slots, and a slot names its state, so one vector step advances many text segments in all languages at once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAD, STRANGE, BREAK = 0, 1, 2
SEGMENT = 512
LANES = 8192
TEXT_CODES = 1 << 21


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def placed(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of sparse rows in one array: the transition of row ``s`` by ``c`` is at ``shift[s] + c`` if that slot's owner is ``s``."""
    size = 3 * sum(map(len, rows)) + width
    owner, to, shift = [-1] * (size + width), [0] * (size + width), np.zeros(len(rows), np.int64)
    at = 0
    for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
        codes = list(rows[s])
        while any(owner[at + c] >= 0 for c in codes):
            at = (at + 1) % size
        shift[s] = at
        for c in codes:
            owner[at + c], to[at + c] = s, rows[s][c]
        at = (at + 7919) % size
    return shift, np.array(owner, np.int32), np.array(to, np.int32)


class Parser:
    """Phrase counts of texts against the samples of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.width = len(letters) + 3
        self.code_of = np.full(0x110000, BREAK, np.min_scalar_type(self.width))
        strange = np.fromiter((i for i in range(0x110000) if chr(i).isalpha()), np.int64)
        self.code_of[strange] = STRANGE
        for i, c in enumerate(letters):
            self.code_of[[ord(x) for x in {c, c.upper()} if len(x) == 1]] = i + 3
        rows, self.starts = [], []
        self.first = np.zeros((len(samples), self.width), np.int32)
        for own, (_, text) in zip(self.first, samples):
            base, moves = len(rows), automaton(self.codes(text).tolist())
            rows += [{c: base + to for c, to in m.items()} for m in moves]
            # One more state, without transitions, stands between phrases: whatever comes next begins one.
            self.starts.append(len(rows))
            own[:] = len(rows)
            own[list(rows[base])] = list(rows[base].values())
            rows.append({})
        self.shift, self.owner, self.to = placed(rows, self.width)
        self.bits = np.log2([max(len(text), 2) for _, text in samples])

    def codes(self, text: str) -> np.ndarray:
        """Letter codes in lower case; each run of other characters is one break."""
        codes = self.code_of[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = codes == BREAK
        return codes[np.concatenate([[True], ~(gap[1:] & gap[:-1])])] if len(codes) else codes

    def phrases(self, codes: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language. Texts are parsed in segments of a fixed length, so long ones take as many lanes as they need."""
        counts = [-(-len(c) // SEGMENT) for c in codes]
        owner = np.repeat(np.arange(len(codes)), counts)
        total = np.zeros((len(codes), len(self.langs)), np.int64)
        if not len(owner):
            return total
        flat = np.concatenate([*codes, np.zeros(SEGMENT, self.code_of.dtype)])
        text_at = np.concatenate([[0], np.cumsum([len(c) for c in codes])[:-1]]) if len(codes) else np.zeros(0)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = text_at[owner] + within * SEGMENT
        size = np.minimum(SEGMENT, np.array([len(c) for c in codes])[owner] - within * SEGMENT)
        order = np.argsort(-size, kind="stable")
        step = np.arange(SEGMENT)
        for lo in range(0, len(order), LANES):
            lanes = order[lo:lo + LANES]
            longest = size[lanes[0]]
            block = np.ascontiguousarray(np.where(step[:longest] < size[lanes, None], flat[at[lanes, None] + step[:longest]], PAD).T)
            active = np.searchsorted(-size[lanes], -step[:longest], side="left")
            state = np.repeat(np.array(self.starts, np.int32)[:, None], len(lanes), 1)
            found = np.zeros(state.shape, np.int32)
            for t in range(longest):
                n = active[t]
                own, code = state[:, :n], block[t, :n]
                slot = self.shift[own] + code
                goes = self.owner[slot] == own
                found[:, :n] += ~goes
                state[:, :n] = np.where(goes, self.to[slot], self.first[:, code])
            np.add.at(total, owner[lanes], found.T)
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return langs, scores
        lo = 0
        while lo < len(texts):
            codes, rows, held = [], [], 0
            while lo < len(texts) and held < TEXT_CODES:
                c = self.codes(texts[lo] or "")
                if np.any(c != BREAK):
                    codes.append(c)
                    rows.append(lo)
                    held += len(c)
                lo += 1
            if not rows:
                continue
            rate = self.phrases(codes) * self.bits / np.array([len(c) for c in codes])[:, None]
            weight = np.exp2(rate.min(1, keepdims=True) - rate)
            best = rate.argmin(1)
            share = weight.max(1) / weight.sum(1)
            for r, b, s in zip(rows, best, share):
                langs[r], scores[r] = self.langs[b], float(s)
        return langs, scores


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """Built once per Python worker: what is shipped to the tasks is only the sampled text."""
    return Parser(samples)


def labelled_sample(rows: DataFrame, per_lang: int = 40, excerpt: int = 400, max_rows: int = 8192) -> tuple[tuple[str, str], ...]:
    """``((lang, text), ...)`` in order of language: at most ``per_lang`` rows a language, chosen by hash, an excerpt of each.

    ``max_rows`` bounds the whole sample; the languages share it evenly.
    """
    by_hash = F.xxhash64("doc_id", "text")
    spot = (F.pmod(by_hash, F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1).cast("int")
    kept = (
        rows.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang", "text", by_hash.alias("h"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
        .where(F.col("rank") <= per_lang).select("lang", "rank", F.substring("text", spot, F.lit(excerpt)).alias("part"))
        .orderBy("rank", "lang").head(max_rows))
    texts: dict[str, list[str]] = {}
    for r in kept:
        texts.setdefault(r["lang"], []).append(r["part"])
    return tuple((lang, "\n".join(texts[lang])) for lang in sorted(texts))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of columns of these names; prediction looks at ``text`` alone.

    Missing texts, texts without a letter and all texts if there are no samples are ``und`` with score 0. Ties go to the
    language first in alphabetical order; repeated rows are repeated; no rows give no rows.
    """
    kept = docs.drop("lang_pred", "score")
    at = kept.columns.index("text")
    if not samples:
        return kept.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})

    def run(batches):
        model = parser(samples)
        for batch in batches:
            langs, scores = model.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [
                *batch.schema.names, "lang_pred", "score"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{names}, lang_pred string, score double")
