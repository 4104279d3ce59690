"""Fill-in-middle and token counts against plain Python and the tokenizer itself."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim, tokencount

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "a", "é", "abc def", "日本語 text 𝄞𝄞 café\n\r\n\tx", "no <P> here", "<", "x<S", "S>x", "a<S>b", "<M>", "ab1c\x00d", "é" * 7,
         "word " * 40_000 + "ü" * 300, "x" * 2_500_000, ("né 中" * 3 + "abc") * 90_000, "​́ é", "<P", "end<", "\\$1 $2 \\"]
DOCS = "doc_id long, text string, cut string, h1 string, n long"


def plain_fim(doc_id, text, unit=r"[A-Za-z]+|[^A-Za-z]"):
    text = text or ""
    units = re.findall(unit, text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", "h", 1) for i, t in enumerate(TEXTS * 3)] + [(None, "missing id é", None, None, None), (4, TEXTS[4], "c", "h", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache(), rows


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("unit,pattern", [("word", r"[A-Za-z]+|[^A-Za-z]"), ("char", r".")])
def test_fill_in_middle_matches_plain_cuts(docs, unit, pattern):
    df, rows = docs
    got = [tuple(r) for r in fim.fill_in_middle(df, unit=unit).collect()]
    assert ordered(got) == ordered([(r[0], *plain_fim(r[0], r[1], pattern)) for r in rows])
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_restores_texts(docs):
    df, rows = docs
    back = fim.fill_in_middle(df).select("doc_id", fim.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert ordered([tuple(r) for r in back]) == ordered([(r[0], r[1] or "") for r in rows])
    digested = fim.digests(fim.fill_in_middle(df)).collect()
    assert ordered([(r.doc_id, r.restored_sha256) for r in digested]) == ordered(
        [(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows])


def test_marks_that_touch_cuts_are_restored(spark):
    """Texts made of pieces of marks, cut everywhere."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("<>PSMé"), rng.integers(1, 9)))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.fill_in_middle(df, plain_from=100, spm_below=50).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert ordered([(r.doc_id, r.back) for r in made.collect()]) == ordered(rows)


def test_index_converts_both_ways(monkeypatch):
    monkeypatch.setattr(fim, "STEP", 7)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc é中𝄞\n"), rng.integers(0, 40))) for _ in range(60)] + ["", ""]
    raw = "".join(texts).encode()
    index = fim.Exceptions(np.frombuffer(raw, np.uint8))
    starts = np.array([len("".join(texts)[:k].encode()) for k in range(len("".join(texts)) + 1)])
    assert (index.chars(starts) == np.arange(len(starts))).all() and (index.bytes(np.arange(len(starts))) == starts).all()
    assert len(index.at) == sum(c > "\x7f" for t in texts for c in t)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    units = fim.Units(np.frombuffer(raw, np.uint8), offsets)
    own = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert units.counts().tolist() == [len(u) for u in own]
    ends = np.cumsum([0] + [len(x.encode()) for u in own for x in u])
    assert units.bytes(np.arange(len(ends))).tolist() == ends.tolist()
    array = pa.array(["skipped é", *texts, "behind"]).slice(1, len(texts))
    first, second = rng.integers(0, 2**32, (2, len(texts)))
    n, *_ = fim._cuts(array, first, second, "word")
    assert n.tolist() == [len(u) for u in own]


def test_fill_in_middle_of_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert fim.digests(fim.fill_in_middle(none)).collect() == []
    assert tokencount.token_counts(none, TOKENIZER).collect() == []


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]


MORE = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", " <|endoftext|", "don't we'll I'M they've 'so", "  \t\n x  ", "   a\u0085b", "١٢٣ ½",
        "՘֋ odd", "\U0001df1f", "👍🏽 ok", "naïve 中文字符 한국어", "a" * 100_000, " " * 50_000 + "b", "\r\n\r\n", "x'", "'''s"]


def test_token_counts_match_the_library(spark, docs, sf, monkeypatch):
    df, rows = docs
    texts = [r[1] for r in rows] + MORE
    rows = [(i, t, "x", "y", 0) for i, t in enumerate(texts)]
    got = tokencount.token_counts(spark.createDataFrame(rows, DOCS), TOKENIZER).collect()
    want = library([t or "" for t in texts])
    assert sorted(tuple(r) for r in got) == [(i, len((t or "").encode()), n, n > 1024) for i, (t, n) in enumerate(zip(texts, want))]
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    found = tokencount.token_counts(spark.createDataFrame(given), TOKENIZER).toPandas().set_index("doc_id")["n_tokens"]
    assert found.to_dict() == dict(zip(given["doc_id"], library([t or "" for t in given["text"]])))


def test_small_caches_and_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab '\n\ts1é.中<|"), rng.integers(0, 60))) for _ in range(400)] + MORE
    want = library(texts)
    monkeypatch.setattr(tokencount, "HELD", 5)
    monkeypatch.setattr(tokencount, "CACHE", 40)
    assert tokencount.TokenCounter(TOKENIZER).counts(texts) == want


def test_whole_tokens_are_proved():
    tokenizer, added = tokencount.load(TOKENIZER)
    whole = tokencount.whole_tokens(tokenizer, added)
    assert added == ["<|endoftext|>"] and "<|endoftext|>" not in whole and {" the", "ing", "\n"} <= whole
    some = sorted(whole)[::97]
    ids = [tokenizer.encode(s, add_special_tokens=False).ids for s in some]
    assert all(len(i) == 1 for i in ids) and tokenizer.decode_batch(ids) == some
    # Only tokens that are no whole characters are left out.
    left = [s for i in tokenizer.get_vocab().values() if (s := tokenizer.decode([i], skip_special_tokens=False)) not in whole]
    assert all("�" in s for s in left if s not in added)


def test_split_pattern_agrees_on_all_stated_characters():
    tokenizer, _ = tokencount.load(TOKENIZER)
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    for low, high in tokencount.ALIKE:
        for lo in range(low, high + 1, 4096):
            chars = [chr(c) for c in range(lo, min(lo + 4096, high + 1)) if not 0xD800 <= c < 0xE000]
            text = "".join(f"a{c}1{c}!{c} {c}z" for c in chars)
            assert [text[a:b] for _, (a, b) in split(text)] == tokencount.PATTERN.findall(text), hex(lo)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencount.load(public_tokenizers.path("word_bpe_49k.json"))
