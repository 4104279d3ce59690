"""The training-data operators against brute force on small fixtures, with missing values, ties, repeats and empty tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, components, langid, lattice, lines, multiindex, near, packing, queries, simhash, spans, urls, winnow

WORDS = "the of and thing erth ndly tion wher hast oned ingou thesh reand blest inthe atth esor".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    base = ["\n".join(prose(rng, 25) for _ in range(4)) for _ in range(25)]
    near = base[0].replace(base[0].split()[3], "changed", 1)
    texts = [*base, base[1], near, base[2] + "\n" + base[3].split("\n")[0], None, "", "   ", "123 !!", "one", "a b", "x" * 30_000, prose(rng, 6000)]
    rows = [(i, t, "en" if t else None, "s", len(t or "")) for i, t in enumerate(texts)] + [(5, base[5], "en", "s", 1), (None, base[6], None, None, None)]
    return spark.createDataFrame(rows, DOCS).cache(), rows


def frame(df):
    return df.toPandas()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(7, 7), (3, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_ids_and_sequences(spark, corpus):
    docs, rows = corpus
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = frame(packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)))
    want = {}
    for i, t, *_ in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            want.setdefault((i, k // 2048), []).append((k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())))
    got = {}
    for r in out.itertuples():
        got.setdefault((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 2048) + 1
    assert packing.pack(packing.pieces(docs.limit(0), public_tokenizers.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("text", ["It's <|endoftext|> A.B, c!! don't É́ﬁ 12 x１", " wide space.\x1cend", "<|ENDOFTEXT|> ok. ok, OK: o'LL", "naïve, λόγος. ΣΑΣ ς!", ""])
def test_chunks_give_the_ids_of_the_whole_text(text):
    coder = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_crossover_keeps_every_item_once():
    import random
    rng = random.Random(2)
    sizes = [rng.randint(1, 90) for _ in range(200)]
    best = packing.evolve(sizes, [], 100, 5, 6, 10)
    for _, where in best:
        fill = np.bincount(where, sizes)
        assert len(where) == 200 and fill.max() <= 100


def test_suffix_automaton_parse_is_the_greedy_parse():
    rng = np.random.default_rng(5)
    samples = (("aa", "abracadabra banana"), ("bb", "hocus pocus fidibus"))
    model = langid.Parser(samples)
    for _ in range(30):
        text = "".join(rng.choice(list("abcdhopsun "), int(rng.integers(1, 60))))
        codes = model.codes(text)
        for j, (_, sample) in enumerate(samples):
            own, n, i = model.codes(sample).tobytes(), 0, 0
            data = codes.tobytes()
            while i < len(data):
                k = i + 1
                while k <= len(data) and data[i:k] in own:
                    k += 1
                i, n = max(k - 1, i + 1), n + 1
            assert model.phrases([codes])[0][j] == n


def test_language_id_held_out_and_edges(spark, sf):
    out = frame(queries.op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id"))
    held = out[out.held_out & out.lang.notna() & (out.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "12 !?", 3), (None, "the tion", 4), (4, "日本", 5)], "doc_id long, text string, lang_pred int")
    got = frame(langid.identify(odd, (("de", "die und der"), ("en", "the tion of"))))
    assert got.lang_pred.tolist()[:4] == ["und", "und", "und", "en"] and got.lang_pred[4] in ("de", "en")
    assert set(frame(langid.identify(odd, ())).lang_pred) == {"und"} and langid.identify(odd.limit(0), (("a", "b"),)).count() == 0


def test_language_id_of_large_alphabets():
    rng = np.random.default_rng(12)
    letters = {"zh": range(0x4E00, 0x5200), "ja": range(0x4E00, 0x5200), "k1": range(0xAC00, 0xAE00), "k2": range(0xAC00, 0xAE00), "th": range(0x0E01, 0x0E2F), "ka": range(0x10D0, 0x10F0)}
    words = {lang: ["".join(map(chr, rng.choice(list(own), 3))) for _ in range(60)] for lang, own in letters.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    model = langid.Parser((("en", "the thing and of"), *((lang, text(lang, 400)) for lang in sorted(words))))
    assert model.width > 256
    for lang in words:
        assert set(model.predict([text(lang, 30) for _ in range(10)])[0]) == {lang}


def test_lattice_scores_match_brute_force(spark, corpus):
    docs, rows = corpus
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = frame(lattice.score(docs, path, steps=1))
    tokens = [(i, (t or "").encode().lower().split()) for i, t, *_ in rows]
    train = [w for i, w in tokens if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    from collections import Counter
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = sorted((len(w) + 1, sum(x in c for x in w) + 1, round(sum(math.log10((c[x] + .5) / (n + .5 * (v + 1))) for x in w) + math.log10(
        (len(train) + .5) / (n + .5 * (v + 1))), 4)) for _, w in tokens)
    assert sorted(zip(got.n_tokens, got.n_known, got.base_score.round(4))) == want and set(got.train_tokens) == {n}
    own = lattice.pieces(path)
    weights = np.log(own.prior)
    p = dict(zip(own.keys, own.prior))

    def brute(word):
        ways = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            ways[j] = sum(ways[i] * p.get(word[i:j], 0.0) for i in range(j))
        return math.log(ways[-1])
    some = [b"the", b"thingtion", "größe\x00".encode(), b"q" * 40, "日本▁".encode()]
    assert np.allclose(own.log_probability(some, weights), [brute(b" " + w) for w in some])
    assert lattice.score(docs.limit(0), path).count() == 0


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[100:160] = vectors[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (None, [1.0] * 16, 1), (5060, [1.0], 1), (7, vectors[7].tolist(), 1)]
    got = frame(multiindex.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), queries.F.col("vec_id") % 20 == 0))
    data = vectors.astype(float)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        scores = (data * data[q]).sum(1)
        order = [x for x in np.lexsort((np.arange(1500), -scores)) if x != q][:20]
        hits += len(set(order) & set(own.vec_id))
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, scores[own.vec_id]) and q not in set(own.vec_id)
    assert got.query_id.nunique() == 75 and hits / (75 * 20) >= 0.9
    assert got[got.query_id == 100].sort_values("rank").vec_id.tolist()[:4] == [7, 101, 102, 103]


@pytest.mark.parametrize("sigma", [0.5, 1.0])
def test_nearest_recall_of_different_norms(spark, sigma):
    given = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").embedding
    data = np.stack(given.to_list()).astype(float) * np.random.default_rng(14).lognormal(0, sigma, len(given))[:, None]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>")
    hits, found = 0, frame(multiindex.search(table, queries.F.col("vec_id") % 20 == 0)).groupby("query_id")
    for q, own in found:
        hits += len(set([x for x in np.argsort(-(data @ data[q])) if x != q][:20]) & set(own.vec_id))
    assert len(data) >= 2000 and hits / (len(found) * 20) >= 0.9


@pytest.mark.parametrize("wanted", [1, 700, 1e9])
def test_walk_is_the_order_of_all_pairs(wanted):
    rng = np.random.default_rng(31)
    first, second, counts = rng.random(9), rng.random(7), rng.integers(0, 30, (9, 7))
    bound, held = multiindex.walk(first, second, counts, wanted), 0
    for d, n in sorted((first[i] + second[j], counts[i, j]) for i in range(9) for j in range(7) if counts[i, j]):
        if held < wanted:
            last, held = d, held + n
    assert bound == last


def test_nearest_in_small_blocks_are_the_same(spark, monkeypatch):
    data = np.random.default_rng(32).normal(size=(400, 8))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(data.tolist())], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, multiindex.search(table, queries.F.col("vec_id") % 20 == 0).collect()))]
    monkeypatch.setattr(multiindex, "ASKED", 6)
    monkeypatch.setattr(multiindex, "BLOCK", 30)
    found.append(sorted(map(tuple, multiindex.search(table, queries.F.col("vec_id") % 20 == 0).collect())))
    assert found[0] == found[1] and len(found[0]) == 400


def test_sentence_spans(spark):
    shared = "First of all the passage has many words in it. Then it goes on with a second sentence here. At last a third sentence ends it all."
    rows = [(1, f"Own start here. {shared} Own end of one."), (2, f"Other start now. {shared}\nOther end."), (3, shared), (4, "Clean. Text."), (None, None), (5, ""), (3, shared)]
    got = frame(spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).sort_values("doc_id")
    text = {r.doc_id: r.text for r in got.itertuples() if r.doc_id == r.doc_id}
    assert text[1] == rows[0][1] and text[2] == "Other start now. Other end." and text[3] == "" and text[4] == "Clean. Text." and len(got) == 7
    for t in ("a. b!c 3.5 d?  \n\n e", "", "...", "no end", "x.\ny"):
        assert "".join(spans.sentences(t)) == t


def test_spans_of_long_sentences_other_marks_and_whole_texts(spark):
    rng = np.random.default_rng(18)
    many = lambda n: " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))
    long, passages, signs = many(120), [many(50) for _ in range(20)], "".join(map(chr, rng.integers(0x4E00, 0x9000, 40)))
    rows = [(1, long), (2, long), (3, "One short text"), (4, "one  short text"), (5, signs[:20] + "。" + signs[20:] + "。别的"), (6, "其他。" + signs[:20] + "。" + signs[20:] + "。")]
    rows += [(10 + 2 * i + k, f"{many(9 + i)} {p} {many(12)}") for i, p in enumerate(passages) for k in (0, 1)]
    text = {r["doc_id"]: r["text"] for r in spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert text[1] == long and text[2] == "" and text[3] == "One short text" and text[4] == "" and text[6] == "其他。"
    for i, p in enumerate(passages):
        assert p in text[10 + 2 * i] and p not in text[11 + 2 * i]
    for t in (long, rows[4][1], " a 好。b!? c。」", "x " * 60, "\n\n" + long + "\n y. "):
        assert "".join(p for p, _ in spans.units(t)) == t
    assert spans.sentences("...so it is .5 now. 好。！?好") == ["...so it is .5 now. ", "好。！?", "好"]


def test_spans_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHARS", 2000)
    monkeypatch.setattr(spans, "UNITS", 50)
    rng = np.random.default_rng(31)
    pool = [prose(rng, int(n)) + "." for n in rng.integers(3, 40, 30)]
    rows = [(int(i), " ".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(0, 9)))) for i in rng.permutation(60)]
    rows += [(100, " ".join(pool * 20)), (101, ""), (102, "  \n"), (103, "short"), (104, "Short"), rows[3]]
    seen: dict[tuple, list] = {}
    own = {}
    for i, t in set(rows):
        words = [w for _, w in spans.units(t)]
        ok = lambda a, b: b - a >= 2 and sum(map(len, words[a:b])) >= 20  # noqa: B023, E731
        whole = [(a, b) for a in range(len(words)) for b in range(a + 1, min(len(words), a + 25) + 1) if ok(a, b)]
        places = [(a, b) for a, b in whole if not ok(a, b - 1) or not ok(a + 1, b)] or [(0, len(words))] * bool(sum(map(len, words)))
        own[i, t] = len(words)
        for a, b in places:
            seen.setdefault(tuple(map(tuple, words[a:b])), []).append((i, t, a, b))
    gone: dict[tuple, set] = {}
    for found in seen.values():
        first = min(found, key=lambda f: (f[0], f[2]))
        for i, t, a, b in found:
            if (i, a) != (first[0], first[2]):
                gone.setdefault((i, t), set()).update(range(a, b))
    got = spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and gone
    for r in got:
        t = dict(rows)[r["doc_id"]]
        assert (r["n_sentences"], r["n_removed"]) == (own[r["doc_id"], t], len(gone.get((r["doc_id"], t), ())))
        assert r["text"] == "".join(p for k, (p, _) in enumerate(spans.units(t)) if k not in gone.get((r["doc_id"], t), ()))


def test_spans_keep_columns_of_any_name(spark):
    names = ["key", "mark", "gone", "row", "n", "span", "first", "n_removed", "Mark_"]
    rows = [(i, "One passage. " * 12 + str(i), *[f"{c}{i}" for c in names]) for i in range(3)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = spans.drop_repeats(docs)
    kept = [c for c in names if c != "n_removed"]
    assert got.columns == ["doc_id", "text", *kept, "first_docs", "n_sentences", "n_removed"]
    assert {tuple(r[c] for c in kept) for r in got.collect()} == {tuple(f"{c}{i}" for c in kept) for i in range(3)}
    assert spans.drop_repeats(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    odd = ["<|turn|>", "\\<|end|>", "<\\|text|>", "</s>[INST] ok [/INST]", "[\\INST]", "\\\\", "<", "é\n<|part|>", "", None, "[", "<<SYS>>"]
    rows = [(c, t, r, odd[(c * 5 + t) % len(odd)]) for c in range(12) for t, r in enumerate(["system", "user", "user", "assistant", "assistant", "user<|"])]
    rows += [(None, 1, None, "x"), (99, None, "assistant", "late"), (99, None, "assistant", "late")]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.read_back(chats).collect():
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1] or -1)]
        assert [tuple(t) for t in r["turns"]] == own and r["loss_text"] == "".join(t for role, t in own if role == "assistant")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    a, b = frame(queries.QUERIES[name](spark, sf)), con.execute(queries.ORACLE[name]).df()
    key = a.columns[0]
    a, b = (x[sorted(x.columns)].sort_values(key, ignore_index=True) for x in (a, b))
    assert len(a) and list(a.columns) == list(b.columns) and (a == b).all().all()


def test_winnowing_matches_every_window(spark):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(rng.choice(WORDS, n))) for i, n in enumerate([12, 30, 10, 3, 1, 0, 15])] + [(8, None), (None, "the of and"), (0, "zz yy")]
    docs = [(i, " ".join(rng.choice(WORDS, 40)) + " " + (items[i % 3][1] or "")[8:80].upper() + " qq ") for i in range(12)] + [(20, None), (21, ""), (22, "É of"), (20, "zz, YY")]
    got = {}
    for r in winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in docs[:12]:
        w, hit, met = split(t), set(), set()
        for item, x in items:
            own = split(x)
            n = min(10, len(own))
            for s in range(len(own) - n + 1 if n and item is not None else 0):
                for d in range(len(w) - n + 1):
                    if w[d:d + n] == own[s:s + n]:
                        hit |= set(range(d, d + n))
                        met.add(str(item))
        assert (got[i][0]["n_words"], got[i][0]["n_hit"], got[i][0]["items"]) == (len(w), len(hit), sorted(met))
    assert sorted(r["n_words"] for r in got[20]) == [0, 2] and got[21][0]["n_hit"] == 0


def test_simhash_matches_brute_force(spark, corpus):
    docs, rows = corpus

    def slow(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    fps = [slow(t) for _, t, *_ in rows]
    low = [i if i is not None else 10 ** 9 for i, *_ in rows]
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fps[a] ^ fps[b]).bit_count() <= 2 and low[b] < low[a]:
                    low[a], changed = low[b], True
    want = sorted((f"{f:016x}", c) for f, c in zip(fps, low))
    assert sorted((r["fingerprint"], r["component_id"]) for r in simhash.groups(docs).collect()) == want


@pytest.mark.parametrize("crowd", [3, 4096])
def test_simhash_links_lose_nothing(spark, crowd):
    rng = np.random.default_rng(6)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 40)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (12, 2))} | {int(b) for b in base})
    got = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd=crowd).collect()
    full = lambda x: x & (2 ** 64 - 1)
    assert all((full(r["a"]) ^ full(r["b"])).bit_count() <= 2 for r in got)
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(got, "a long, b long")).collect()}
    for a in fps:
        for b in fps:
            if (full(a) ^ full(b)).bit_count() <= 2:
                assert roots.get(a, a) == roots.get(b, b)


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [(1, "https://www.example.com/en/x?q#f", ""), (2, "http://m.example.com/en/y", ""), (3, "http://a.org/p", link % "http://m.example.com/en/y"),
            (4, "http://b.org/q", '<META http-equiv=refresh content="0; url=//a.org/p">'), (5, "HTTP://X.Net/fr/1", None), (6, None, "x"), (7, "nothing", ""),
            (8, "http://c.org/d/e", link % "z"), (9, "http://c.org/d/z", link % "http://shop.com/1"), (4, "http://b.org/q", ""), (10, "http://com", "")]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2]["verdict"] == "block" and got[3]["verdict"] == "block" and got[4]["verdict"] == "block" and got[3]["rule"] is None
    assert got[5]["rule"] == "net/fr/" and got[6]["host"] == "" and got[7]["path"] == "" and got[7]["verdict"] == "allow"
    assert got[8]["verdict"] == "allow" and got[10]["rule"] is None


@pytest.mark.parametrize("block", [3, 4096])
def test_fuzzy_lines_match_brute_force(spark, block):
    rng = np.random.default_rng(8)
    base = [prose(rng, 20) for _ in range(12)]
    variants = [" ".join(w if j != k else "altered" for j, w in enumerate(b.split())) for b in base[:5] for k in range(6)]
    pool = base + variants + ["short", "short", "", "  " + base[6] + " "]
    texts = ["\n".join(pool[int(i)] for i in rng.integers(0, len(pool), 5)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50, None), (51, ""), (0, texts[0])]
    got = {r["doc_id"]: r for r in lines.drop_similar_lines(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    grams = lambda x: {x.lower().ljust(6, "\0")[i:i + 6] for i in range(max(1, len(x) - 5))}
    flat = [(i, p, x.strip()) for i, t in rows[:20] for p, x in enumerate(t.split("\n")) if x.strip()]
    root = list(range(len(flat)))
    sets = [grams(x) for *_, x in flat]
    changed = True
    while changed:
        changed = False
        for a in range(len(flat)):
            for b in range(a):
                if root[b] < root[a] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    for i, t in rows[:20]:
        gone = {p for k, (d, p, _) in enumerate(flat) if d == i and root[k] != k}
        assert got[i]["text"] == "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    assert got[50]["text"] is None and got[51]["text"] == "" and got[51]["n_removed"] == 0


def test_lines_lose_every_outer_blank_and_hash_their_text_once(spark):
    rows = [(1, "\n".join([f"{a}in {b}ner{b}" for a in lines.BLANKS for b in lines.BLANKS] + ["in ner", "", " \t", "\xa0x"]))]
    found = lines.lines_of(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r["line"] for r in found.orderBy("pos").collect()] == [x.strip(lines.BLANKS) for x in rows[0][1].split("\n") if x.strip(lines.BLANKS)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("isnull(doc_id")  # hashed below the split, not once a line


@pytest.mark.parametrize("most", [1, 50, 1 << 19])
def test_band_keys_travel_in_few_rows_and_lose_no_company(spark, most):
    rng = np.random.default_rng(18)
    texts = [prose(rng, 20) for _ in range(30)]
    texts += [t + " more" for t in texts[:10] for _ in range(3)] + ["same words here %d" % (i % 2) for i in range(20)]
    ids = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    rows = spark.createDataFrame([(ids[t], t) for t in texts], "id long, line string").repartition(3)
    banded = lines._banded(rows)
    assert banded.where("length(keys) > 8").count() and banded.agg({"bucket": "max"}).first()[0] < lines.BUCKETS
    keys = lines.band_keys(lines.signatures(list(ids))).tolist()
    held = {}
    for i, own in enumerate(keys):
        for k in own:
            held.setdefault(k, set()).add(i)
    want = sorted((k, i) for k, own in held.items() if len(own) > 1 for i in own)
    assert want and sorted(map(tuple, lines._crowded(banded, most).collect())) == want


@pytest.mark.parametrize("few", [4, 64])
def test_line_groups_are_compared_together_and_known_roots_are_not_again(monkeypatch, few):
    monkeypatch.setattr(lines, "FEW", few)
    rng = np.random.default_rng(19)
    groups, ids, texts, roots = [], [], [], []
    for n in (1, 2, 2, 5, 9, 30):
        base = [prose(rng, 25) for _ in range(3)]
        groups.append(n)
        for _ in range(n):
            words = base[int(rng.integers(0, 3))].split()
            words[int(rng.integers(0, len(words)))] = "altered"
            texts.append(" ".join(words))
            ids.append(len(ids))
            roots.append(ids[-1] if rng.random() < .6 else roots[-1] if roots else 0)
    grams = [{x.lower()[i:i + 6] for i in range(len(x) - 5)} for x in texts]
    group = np.repeat(range(len(groups)), groups).tolist()

    def joined(links):
        up = list(range(len(ids)))
        for a, b in links + [(i, j) for i in ids for j in ids if group[i] == group[j] and roots[i] == roots[j]]:
            up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
        return up
    near = [(i, j) for i in ids for j in ids[:i] if group[i] == group[j] and len(grams[i] & grams[j]) >= .8 * len(grams[i] | grams[j])]
    got = lines.similar_links(groups, ids, texts, roots)
    assert joined(got) == joined(near) and all((a, b) in near or (b, a) in near for a, b in got)
    assert got and not any(group[a] == group[b] and roots[a] == roots[b] for a, b in got)


@pytest.mark.parametrize("cut, end", [(lines.drop_similar_lines, "\n"), (spans.drop_repeats, "\n")])
def test_texts_without_an_id_or_with_the_same_are_cut_each_by_itself(spark, cut, end):
    rng = np.random.default_rng(15)
    shared, own = prose(rng, 25) + end + prose(rng, 25), [prose(rng, 25) + end + prose(rng, 25) for _ in range(6)]
    rows = [(1, own[0] + end + shared), (2, own[1] + end + shared), (2, own[2] + end + own[3]), (None, own[4] + end + shared), (None, own[5] + end + own[5][::-1])]
    got = sorted(r["text"].strip() for r in cut(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # A missing id comes first, so that row keeps what is shared; nothing else goes.
    assert got == sorted([own[0], own[1], rows[2][1], rows[3][1], rows[4][1]])
    rows = [(None, own[0] + end + shared), (None, own[1] + end + shared), (7, own[2] + end + shared), (7, own[3] + end + shared)]
    got = [r["text"].strip() for r in cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(shared in t for t in got) == 1 and all(sum(o in t for t in got) == 1 for o in own[:4])


def test_pipeline_stages(spark, sf, corpus):
    docs, rows = corpus
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    docs = docs.unionByName(spark.createDataFrame([(900, "before " + benchmark + " after", "en", "s", 1)], DOCS))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = frame(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = set(seen["decontamination"].doc_id.dropna().astype(int))
    # A row without an id comes first, so it keeps the text that it shares with document 6.
    assert not kept & {6, 25, 28, 29, 30, 31, 900} and set(range(3, 25)) - {6} <= kept
    packed = seen["packing"]
    assert set(packed.doc_id.dropna().astype(int)) == kept and packed.groupby("sequence_id").length.sum().max() <= 2048
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_stages_keep_rows_without_ids_and_with_the_same(spark, sf):
    rng = np.random.default_rng(16)
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    clean = [prose(rng, 60) for _ in range(8)]
    rows = [(None if i < 4 else 5, t, "en", "s", 1) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([*rows, rows[0], rows[7]], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()) == sorted(clean)
    docs = spark.createDataFrame([*rows, *((i, "before " + benchmark + " after", "en", "s", 1) for i in (None, 5))], DOCS)
    assert sorted(r["text"] for r in corpus_pipeline.decontamination(spark, docs, sf).collect()) == sorted(clean)


@pytest.mark.parametrize("chars", [1000, near.CHARS])
def test_near_documents_match_brute_force(spark, sf, monkeypatch, chars):
    monkeypatch.setattr(near, "CHARS", chars)
    rng = np.random.default_rng(17)
    texts = []
    for _ in range(8):
        words = rng.choice(WORDS, 200).tolist()
        texts += [" ".join("altered" if j in set(rng.integers(0, 200, n)) else w for j, w in enumerate(words)) for n in (0, 1, 3, 5, 9)] + ["\n".join(words).upper()]
    texts += ["one two", "One\ntwo", "three"]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root, changed = list(range(len(texts))), True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if root[b] < root[a] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b]):
                    root[a], changed = root[b], True
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect())
    assert kept == sorted(set(root)) and len(kept) < len(texts) - 10


def test_simhash_stage_finds_close_texts_by_fingerprints(spark, sf, monkeypatch):
    # Without bands only fingerprints are left to find what differs in a word or two; the exact similarity still decides.
    monkeypatch.setattr(near, "band_keys", lambda grams: [])
    rng = np.random.default_rng(23)
    base = [prose(rng, 6000) for _ in range(6)]
    texts = [t for b in base for t in (b, b + " end", "first " + b)]
    prints = [simhash.majority(near.shingles(t.lower().split())) for t in texts]
    assert max((prints[i] ^ prints[i - i % 3]).bit_count() for i in range(len(texts))) <= 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, sf).collect()) == list(range(0, 18, 3))


def test_dedup_stages_plan_in_small_steps(spark, sf, corpus):
    # The driver keeps, and after each stage renews, the whole plan of a job: one plan for all steps of a stage takes it too much memory.
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    corpus_pipeline.line_dedup(spark, corpus[0], sf).count()
    corpus_pipeline.simhash_dedup(spark, corpus[0], sf).count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    own = store.executionsList(before, store.executionsCount() - before)
    sizes = [len(own.apply(i).physicalPlanDescription()) for i in range(own.size())]
    assert len(sizes) > 20 and max(sizes) < 36_000, sizes


def test_cells_are_those_within_one_step(spark):
    fps = [0, -1, 1 << 62, -(1 << 63), 0x0123456789ABCDEF, -0x0123456789ABCDEF]
    made = spark.createDataFrame([(f,) for f in fps], "fp long").withColumn("own", simhash._own_cell(F.col("fp")))
    for fp, got in made.select("fp", simhash._cells(F.col("own"))).collect():
        counts = [(fp >> 4 * i & 15).bit_count() for i in range(16)]
        near = [counts] + [counts[:i] + [c + d] + counts[i + 1:] for i, c in enumerate(counts) for d in (-1, 1) if 0 <= c + d <= 4]
        assert sorted(got) == sorted(sum(c << 4 * i for i, c in enumerate(x)) for x in near)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
