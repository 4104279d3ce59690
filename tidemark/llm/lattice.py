"""Document likelihood under a subword lattice: every segmentation into vocabulary pieces counts.

The pieces and their first weights come from an existing subword vocabulary with scores; expectation steps over the corpus fit
the weights (the pieces stay as they are). Pieces begin but never cross a word, so the probability of a text, summed over all
its segmentations, is the product over its words and one end. Each distinct word is scored once, by forward recursion in log
space over its lattice, and the documents gather the scores of their words.

Flow: documents are read once into blocks of word occurrences; words are counted and scored globally, then return to the blocks
that hold them. A frequent word has one row per block, not per occurrence, so no word is a hot key.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

from .common import spread

BLOCK_CHARS = 16_000_000
BLOCK_DOCS = 60_000
CELLS = 1 << 19
PRIOR = 1000.0
MARK = "▁"


class Pieces:
    """A vocabulary as a trie in a dense table. Bytes of words are 0 to 255, the word start is 32, the padding 256.

    Byte pieces spell what no other piece covers. Pieces that can't occur in lower-cased words are left out.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keys, scores = [], []
        single = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                key = bytes([int(piece[3:5], 16)])
                if key == b" ":
                    continue
            else:
                if re.search("[A-Z]", piece) or MARK in piece[1:]:
                    continue
                key = piece.replace(MARK, " ").encode()
            if key in single:
                scores[single[key]] = max(scores[single[key]], model.get_score(i))
                continue
            single[key] = len(self.keys)
            self.keys.append(key)
            scores.append(model.get_score(i))
        for b in range(256):  # whatever the vocabulary, every byte but white space can be spelt
            if bytes([b]) not in single and (b > 32 or b < 9 or 13 < b < 32):
                self.keys.append(bytes([b]))
                scores.append(min(scores, default=0.0))
        if b" " not in single:
            self.keys.append(b" ")
            scores.append(min(scores, default=0.0))
        # Scores of a merge vocabulary are minus the rank: weights fall with the rank as word frequencies do.
        scores = np.array(scores)
        weights = 1.0 / (scores.max() - scores + 10.0)
        self.prior = weights / weights.sum()
        nodes = [{}]
        self.piece_at = [-1]
        for k, key in enumerate(self.keys):
            at = 0
            for b in key:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    self.piece_at.append(-1)
                at = nodes[at][b]
            self.piece_at[at] = k
        # Node 0 is the start and, as a target, the end of all paths.
        self.next = np.zeros((len(nodes), 257), np.int32)
        for s, to in enumerate(nodes):
            self.next[s, list(to.keys())] = list(to.values())
        self.next = self.next.ravel()
        self.piece_at = np.array(self.piece_at, np.int32)
        self.depth = max(map(len, self.keys))

    def chunks(self, words: list[bytes]):
        """Words of similar length as a byte matrix: (order in ``words``, bytes with the word start, lengths)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        lo = 0
        while lo < len(order):
            hi = lo + 1
            step = max(1, CELLS // int(sizes[order[lo]] + 1))
            hi = min(len(order), lo + step)
            while hi - lo > 1 and (hi - lo) * int(sizes[order[hi - 1]] + 1) > 2 * CELLS:
                hi = lo + (hi - lo) // 2
            part = order[lo:hi]
            width = int(sizes[part[-1]])
            matrix = np.full((len(part), width), 256, np.int32)
            matrix[:, 0] = 32
            inside = np.arange(1, width)[None, :] < sizes[part][:, None]
            matrix[:, 1:][inside] = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            yield part, matrix, sizes[part]
            lo = hi

    def forward(self, matrix: np.ndarray, sizes: np.ndarray, weights: np.ndarray, edges: list | None = None) -> np.ndarray:
        """Log of the summed probability of all ways to reach each place of each word; rows are places."""
        alpha = np.full((matrix.shape[1] + 1, len(matrix)), -np.inf)
        alpha[0] = 0.0
        columns = np.ascontiguousarray(matrix.T)
        for i in range(matrix.shape[1]):
            rows = np.arange(np.searchsorted(sizes, i, side="right"), len(sizes), dtype=np.int64)
            state = np.zeros(len(rows), np.int32)
            for d in range(min(self.depth, matrix.shape[1] - i)):
                state = self.next[state * 257 + columns[i + d, rows]]
                live = state > 0
                rows, state = rows[live], state[live]
                if not len(rows):
                    break
                piece = self.piece_at[state]
                whole = piece >= 0
                at, piece = rows[whole], piece[whole]
                if len(at):
                    to = alpha[i + d + 1]
                    to[at] = np.logaddexp(to[at], alpha[i, at] + weights[piece])
                    if edges is not None:
                        edges.append((i, i + d + 1, at, piece))
        return alpha

    def log_probability(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words))
        for part, matrix, sizes in self.chunks(words):
            alpha = self.forward(matrix, sizes, weights)
            out[part] = alpha[sizes, np.arange(len(part))]
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all segmentations of all words, weighted by probability and word count."""
        used = np.zeros(len(self.keys))
        for part, matrix, sizes in self.chunks(words):
            edges: list = []
            alpha = self.forward(matrix, sizes, weights, edges)
            lanes = np.arange(len(part))
            total = alpha[sizes, lanes]
            beta = np.full(alpha.shape, -np.inf)
            beta[sizes, lanes] = 0.0
            edges.sort(key=lambda e: -e[0])
            for i, j, at, piece in edges:
                through = weights[piece] + beta[j, at]
                beta[i, at] = np.logaddexp(beta[i, at], through)
                share = np.exp(alpha[i, at] + through - total[at]) * counts[part[at]]
                used += np.bincount(piece, share, len(used))
        return used


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _blocks(docs: DataFrame, folds: int) -> DataFrame:
    """Blocks of documents: a row per distinct word with its places, and one without a word for the documents.

    ``places`` are 16-bit places of documents in the block, one per occurrence; ``c`` counts those in training documents. The
    row of the documents holds ids, folds and numbers of words, and in ``c`` how many are training documents.
    """
    schema = "block long, word string, c long, places binary"
    names = ["block", "word", "c", "places"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def close(block, vocabulary, tokens, ids, held):
        sizes = np.array([len(t) for t in tokens], np.int64)
        words = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        places = np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
        train = np.repeat(~np.array(held, bool), sizes)
        order = np.argsort(words, kind="stable")
        counts = np.bincount(words, minlength=len(vocabulary))
        learned = np.bincount(words, train, len(vocabulary)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)]) * 2
        flat = places[order].astype("<u2").tobytes()
        cuts = ends.tolist()
        rows = pa.array([flat[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
        n = len(vocabulary)
        head = pickle.dumps((ids, held, sizes.tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((block, None, len(ids) - sum(held), head), kinds)], names)
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), pa.array(list(vocabulary), pa.binary()).cast(pa.string()), pa.array(learned), rows], names)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        vocabulary: dict = defaultdict(lambda: len(vocabulary))
        tokens, ids, held, chars = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = (text.as_py() or b"").lower().split()
                tokens.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                ids.append(doc_id)
                held.append(doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 1)
                chars += len(text.as_py() or b"")
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield from close(block, vocabulary, tokens, ids, held)
                    vocabulary.clear()
                    tokens, ids, held, chars = [], [], [], 0
                    block += 1
        if ids:
            yield from close(block, vocabulary, tokens, ids, held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def fit(words: DataFrame, ends: float, vocabulary: str, steps: int = 4) -> tuple[np.ndarray, float]:
    """Log weights of the pieces and of the end, from ``words(word, c)`` and the number of training texts.

    Every step adds up the expected use of each piece over all words; what reaches the driver is one number per piece.
    """
    own = pieces(vocabulary)
    use = np.zeros(len(own.keys))
    for _ in range(steps):
        total = use.sum() + PRIOR
        weights = np.log((use + PRIOR * own.prior) / total)

        def run(batches, weights=weights):
            lattice = pieces(vocabulary)
            used = np.zeros(len(lattice.keys))
            for batch in batches:
                used += lattice.expected(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy().astype(float), weights)
            some = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(used[some])], ["piece", "used"])

        sums = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used"))
        use = np.zeros(len(own.keys))
        for r in sums.head(len(own.keys)):
            use[r["piece"]] = r["used"]
    total = use.sum() + PRIOR + ends + 1.0
    return np.log((use + PRIOR * own.prior) / total), math.log((ends + 1.0) / total)


def score(docs: DataFrame, vocabulary: str, folds: int = 5, steps: int = 4) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs(doc_id, text)``.

    ``base_score`` is the smoothed word unigram of the training rows, ``score`` the lattice; both are log10 probabilities of
    the whole text with its end. A missing text is empty: only its end counts. Rows without an id are training rows; repeated
    rows count and are scored as often as they come; no rows give no rows.
    """
    blocks = materialize(_blocks(docs, folds), "lattice-blocks")
    words = materialize(spread(blocks.where("word is not null").groupBy("word").agg(F.sum("c").alias("c"))), "lattice-words")
    known = words.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = blocks.where("word is null").agg(F.sum("c").alias("n")).first()["n"] or 0
    train, distinct = known["n"] + ends, known["v"] + (ends > 0)
    weights, end_weight = fit(words, float(ends), vocabulary, steps)
    floor = math.log10(train + 0.5 * (distinct + 1))

    def rate(batches):
        lattice = pieces(vocabulary)
        for batch in batches:
            own = lattice.log_probability(batch.column(0).cast(pa.binary()).to_pylist(), weights) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], ["word", "c", "score"])

    rated = materialize(words.select("word", "c").mapInArrow(rate, "word string, c long, score double"), "lattice-rated")
    back = blocks.where("word is not null").select("block", "word", "places").join(rated, "word").select("block", "c", "score", "places")
    heads = blocks.where("word is null").select("block", F.lit(-1).cast("long").alias("c"), F.lit(0.0).alias("score"), "places")
    end_base = math.log10(ends + 0.5) - floor
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def close(counts, scores, parts):
        c, own, places = np.concatenate(counts), np.concatenate(scores), pa.concat_arrays(parts)
        ids, held, sizes = pickle.loads(places[int(np.flatnonzero(c < 0)[0])].as_py())
        words = c >= 0
        c, own, places = c[words], own[words], places.filter(pa.array(words))
        ends_at = np.frombuffer(places.buffers()[1], np.int32, len(places) + 1, 4 * places.offset) if len(places) else np.zeros(1, np.int32)
        at = np.frombuffer(places.buffers()[2], "<u2", (ends_at[-1] - ends_at[0]) // 2, ends_at[0]) if ends_at[-1] else np.zeros(0, "<u2")
        repeats, n = np.diff(ends_at) // 2, len(ids)
        base = np.bincount(at, np.repeat(np.log10(c + 0.5) - floor, repeats), n)
        model = np.bincount(at, np.repeat(own, repeats), n)
        seen = np.bincount(at, np.repeat(c > 0, repeats), n).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.array(sizes, np.int64) + 1), pa.array(seen + int(ends > 0)),
            pa.array(np.full(n, train, np.int64)), pa.array(base + end_base), pa.array(model + end_weight / math.log(10))], names)

    def gather(batches):
        """Rows come sorted by block: one block is held at a time, its bytes as they came."""
        block, held = None, ([], [], [])
        for batch in batches:
            keys = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
            for lo, hi in zip(bounds, bounds[1:]):
                if keys[lo] != block:
                    if block is not None:
                        yield close(*held)
                    block, held = keys[lo], ([], [], [])
                part = batch.slice(lo, hi - lo)
                held[0].append(part.column(1).to_numpy())
                held[1].append(part.column(2).to_numpy())
                held[2].append(part.column(3))
        if block is not None:
            yield close(*held)

    return spread(back.unionByName(heads), "block").sortWithinPartitions("block").mapInArrow(
        gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
