"""The ten operators against brute force on small fixtures: nulls in any column,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import (ann, common, decontam, langid, license_scan, line_dedup, lm_score, near_dup, piece_codec,
                            token_counts, token_store, word_tokens)
from corpusflow.llm.components import connected_components

LINE = "This very line is long enough to be repeated in many documents."


def words(n, seed, start=0):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eta", "theta", "iota", "kappa", "lambda", "mu"])
                    + str(rng.randrange(30)) for _ in range(start, n))


def base_text(i):
    return f"{words(60, i)}\n{LINE}\nmehr über Straße {i}"


def texts():
    out = [base_text(i) for i in range(8)]
    out += [None, "", "   ", "123 456", "one two", "One  two", base_text(0), "日本語 ▁ x",
            "CC-BY and all RIGHTS reserved, GNU General Public License v3", words(5000, 99),
            base_text(1).replace("mehr", "sehr")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, None, i) for i, t in enumerate(texts())]
    rows += [(None, "no id here", "de", "s", 1), rows[3], rows[3]]
    # names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, word string, n_words long").withColumns(
        {c: common.F.lit("x") for c in ("row", "kept", "found", "key", "id", "h", "rid", "ids", "at", "keys")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def collect(df):
    return [r.asDict() for r in df.collect()]


# 1 -------------------------------------------------------------------------

def test_nearest_finds_brute_force_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50] = x[51] = x[60]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (None, [1.0] * 8),
             (1080, [1.0]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", common.F.lit("x"))
    got = collect(ann.nearest(df, common.F.col("vec_id") % 20 == 0, top=5))
    assert {r["query_id"] for r in got} == set(range(0, 400, 20))
    hits = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        hits += len(set(want) & {r["vec_id"] for r in mine})
    assert hits >= 90


def recall(df, x, queries, top=20, **index):
    got = collect(ann.nearest(df, common.F.col("vec_id").isin(queries), top=top, **index))
    hits = 0
    for q in queries:
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:top]
        hits += len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q})
    return hits / (top * len(queries))


def test_nearest_beside_a_few_very_long_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    x[[7, 700, 1400]] *= 100
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(df, x, list(range(0, 2000, 40)), leaf=64) >= 0.9


def test_nearest_walks_to_the_end_or_raises(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="graph"):
        ann.Index(df, leaf=32, trees=4, rounds=1)
    index, queries = ann.Index(df, leaf=32, trees=4), df.where("vec_id < 3").select("vec_id")
    with pytest.raises(RuntimeError, match="beams"):
        index.search(queries, rounds=2)
    # two nodes a round: in ten rounds a beam of 61 could not be expanded
    got = collect(index.search(queries, beam=60, expand=2))
    for q in range(3):
        s = x @ x[q]
        want = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], i))[:20]
        assert len(set(want) & {r["vec_id"] for r in got if r["query_id"] == q}) >= 18


@pytest.mark.parametrize("n", [2, 3, 25])
def test_nearest_of_tiny_tables_is_complete(spark, n):
    """On a line, half of the vectors opposite to the others."""
    df = spark.createDataFrame([(i, [float(1 + i // 2) * (-1) ** i, 0.0]) for i in range(n)],
                               "vec_id long, embedding array<double>")
    got = collect(ann.nearest(df, common.F.lit(True)))
    assert {q: sum(r["query_id"] == q for r in got) for q in range(n)} == {q: min(20, n - 1) for q in range(n)}


def test_nearest_of_equal_vectors_and_of_none(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got = collect(ann.nearest(df, common.F.col("vec_id") == 3, top=4))
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 4]
    assert ann.nearest(df.limit(0), common.F.col("vec_id") == 3).count() == 0


# 2 -------------------------------------------------------------------------

def brute_pieces(codec, scores, text):
    w, best, back = " " + text, [0.0], [0]
    for end in range(1, len(w) + 1):
        ways = [(best[s] + scores[w[s:end]], -s) for s in range(max(0, end - 16), end) if w[s:end] in scores]
        if w[end - 1] not in scores:
            ways.append((best[end - 1] + codec.unknown, 1 - end))
        top, at = max(ways)
        best.append(top)
        back.append(-at)
    return best[-1]


def test_codec_is_the_best_segmentation_and_round_trips():
    import sentencepiece
    model = common.read_bytes(common.tokenizer_path("piece_bpe_32k.model"))
    codec, sp = piece_codec.PieceCodec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    scores = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in range(259, sp.get_piece_size())}
    some = [t for t in texts() if t] + ["don't (.. x).y a.b.c http://foo.com/?q=1", "  lead", "a \n\n b  ", "▁▁"]
    for text, got in zip(some, codec.encode([t.encode() for t in some])):
        ids = np.frombuffer(got, np.int32).tolist()
        assert codec.decode(ids).decode() == text
        mine = sum(scores[codec.bytes_of[i].decode()] for i in ids if i >= 259)
        lost = sum(c not in scores for c in " " + text)
        assert mine + lost * codec.unknown == pytest.approx(brute_pieces(codec, scores, text))


def test_encode_documents(docs, empty):
    got = collect(piece_codec.encode_documents(docs))
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert {r["n_tokens"] for r in got if not r["text"]} == {0}
    assert piece_codec.encode_documents(empty).count() == 0


# 3, 4 ----------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(common.tokenizer_path("word_bpe_49k.json"))


@pytest.mark.parametrize("kept", [400_000, 50])
def test_word_tokenizer_equals_the_library(tokenizer, monkeypatch, kept):
    """Hard characters, contractions and special strings; also with a table of
    words that is cleared all the time."""
    monkeypatch.setattr(word_tokens, "_CACHE_WORDS", kept)
    own = word_tokens.WordTokenizer(common.read_bytes(common.tokenizer_path("word_bpe_49k.json")))
    rng, chars = random.Random(1), "aAbBzZéÉßŒœÿŸĿŉſİıt09.,'!?<|>-_()\"`~^ \t\n日éⅣ½ªµ×"
    some = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(1500)]
    some += ["<|endoftext|> a", "don't DON'T. x's", "a.b", "abc.", "abc'", "Straße,"]
    for at in range(0, len(some), 100):
        part = some[at:at + 100]
        for text, got in zip(part, own.encode([t.encode() for t in part])):
            assert np.frombuffer(got, own.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_store(spark, docs, empty, tokenizer):
    rows = collect(docs.select("doc_id", "text"))
    rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    ids = [tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows]
    store = token_store.TokenStore(spark, token_store.write_tokens(docs, range_bytes=3000, shard_tokens=200))
    got = sorted(collect(store.documents()), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
    assert [r["start"] for r in got] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
    flat = Counter(t for x in ids for t in x)
    some = [t for t, _ in flat.most_common(3)] + [49000]
    assert {r["id"]: r["n"] for r in collect(store.count(some))} == {t: flat[t] for t in some}
    no_id = lambda d: -1 if d is None else d
    places = sorted((no_id(r["doc_id"]), r["i"]) for r in collect(store.occurrences(some[1])))
    assert places == sorted((no_id(r["doc_id"]), i) for r, x in zip(rows, ids) for i, t in enumerate(x) if t == some[1])
    assert [r["id"] for r in collect(store.access(2, 7))] == [ids[[r["doc_id"] for r in rows].index(2)][7]]
    assert token_store.TokenStore(spark, token_store.write_tokens(empty)).documents().count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 3), (1, 1), (700, 5), (5000, 16)):
        v = rng.integers(0, 1 << bits, n).astype(np.uint16)
        wm = token_store.WaveletMatrix.build(v, bits)
        assert (wm.values(np.uint16) == v).all()
        for i in rng.integers(0, n, 20).tolist() if n else []:
            x = int(v[i])
            assert wm.access(i) == x and wm.rank(x, i) == int((v[:i] == x).sum())
            assert wm.select(x, wm.rank(x, i)) == i
        assert wm.select(0, n) == -1


def test_token_counts(spark, docs, empty, tokenizer):
    lens = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("text").collect()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs))
    for r in collect(sums):
        n = r["length"]
        assert r["n_docs"] == lens.count(n) and r["n_tokens"] == n * lens.count(n)
        assert r["docs_from"] == sum(x >= n for x in lens) and r["tokens_from"] == sum(x for x in lens if x >= n)
        assert r["docs_to"] == sum(x <= n for x in lens) and r["tokens_to"] == sum(x for x in lens if x <= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lens)
    limits = spark.createDataFrame([(0,), (3,), (100,), (10 ** 6,)], "limit long")
    assert {r["limit"]: r["truncated_tokens"] for r in collect(token_counts.truncated_total(sums, limits))} == \
        {m: sum(min(x, m) for x in lens) for m in (0, 3, 100, 10 ** 6)}
    assert token_counts.quantile(sums, 0.5).first()[0] == sorted(lens)[math.ceil(len(lens) / 2) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(empty)).count() == 0


# 5, 6, 7 -------------------------------------------------------------------

def test_license_scan(spark, docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in collect(license_scan.scan_licenses(docs))}
    r = next(v for (d, _), v in got.items() if d == 16)
    assert (r["n_base"], r["first_word"], r["base_labels"], r["score"] >= 0.5) == (3, 0, "cc-by,gpl,reserved", True)
    assert got[(8, 0)]["first_word"] is None and got[(8, 0)]["labels"] == ""
    mit = license_scan.TEMPLATES["mit"][0]
    df = spark.createDataFrame([(1, f"intro words {mit.upper()} tail"), (2, "Released under the MIT License."),
                                (3, "the mit and the license of the software")], "doc_id long, text string")
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in collect(license_scan.scan_licenses(df))} == \
        {1: ("mit", 1.0), 2: ("mit", 1.0), 3: ("", 0.0)}
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_finds_key_phrases_of_short_notices(spark):
    """Most words of the templates occur in no document."""
    notice = "licensed under the apache license version 2 0"
    phrases = [(n.partition(":")[0], p) for n, (_, keys) in sorted(license_scan.TEMPLATES.items()) for p in keys]
    df = spark.createDataFrame([(0, f"some code {notice}"), (1, "the license version"), (2, notice.split(" ", 3)[3]),
                                *((3 + i, p) for i, (_, p) in enumerate(phrases))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in collect(license_scan.scan_licenses(df))}
    assert [got[i]["labels"] for i in range(3)] == ["apache-2.0", "", "apache-2.0"]
    assert got[0]["score"] == got[2]["score"] == 1.0
    assert all(n in got[3 + i]["labels"].split(",") for i, (n, _) in enumerate(phrases))
    alone = df.where("doc_id = 0")
    assert [r["labels"] for r in collect(license_scan.scan_licenses(alone))] == ["apache-2.0"]


def test_license_templates_are_found_through_postings_only():
    import copy
    template = {"x": ("alpha beta the gamma delta of epsilon zeta the eta", ["gamma delta of epsilon", "the eta"])}
    words = lambda t: t.encode().split()
    text = words("intro " + template["x"][0] + " outro")
    index = license_scan.build_index({w: 1 for w in text}, template)
    assert license_scan.scan(text, index, {})[1] == {"x": 1.0}
    bare = copy.copy(index)
    bare.postings = {}
    assert license_scan.scan(text, bare, {})[1] == {}
    # the long template needs both phrases in their places, a notice its phrase alone
    long_only = license_scan.build_index({w: 1 for w in text}, template)
    long_only.postings = {w: [(t, i) for t, i in ps if len(long_only.words[t]) > 4] for w, ps in index.postings.items()}
    assert license_scan.scan(text, long_only, {})[1] == {"x": 1.0}
    assert license_scan.scan(words("alpha beta the gamma delta of epsilon zeta"), long_only, {})[1] == {}
    assert license_scan.scan(words("gamma delta of epsilon"), long_only, {})[1] == {}
    assert license_scan.scan(words("gamma delta of epsilon"), index, {})[1] == {"x": 1.0}
    # rare words scattered about agree on no place
    assert license_scan.scan(words("zeta alpha epsilon gamma beta delta eta"), index, {})[1] == {}


def test_license_base_columns_and_labels_equal_plain_search(spark):
    """Random texts of licence words: base places by looking at every word, labels by
    looking for every key phrase."""
    import random
    rnd = random.Random(9)
    pool = [p for _, keys in license_scan.TEMPLATES.values() for p in keys] + list(license_scan.BASE) + \
        ["cc", "by", "general public", "license", "all rights", "reserved", "mit", "the", "x", "\u00e9t\u00e9"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(300)] + [None, "", "CC-BY, cc.by"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in collect(license_scan.scan_licenses(df))}

    def places(words, phrase):
        p = phrase.split()
        return [i for i in range(len(words)) if words[i:i + len(p)] == p]

    for i, t in enumerate(texts):
        words = [w.decode() for w in license_scan.words_of(t.encode() if t is not None else None)]
        base = sorted((k, label) for phrase, label in license_scan.BASE.items() for k in places(words, phrase))
        labels = {label for _, label in base} | {n.partition(":")[0] for n, (_, keys) in license_scan.TEMPLATES.items()
                                                 for p in keys if places(words, p)}
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in base})) and r["labels"] == ",".join(sorted(labels))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)


def test_language_id(spark, docs, empty):
    en = "the house and the garden were quiet in the morning light while they walked"
    de = "das haus und der garten waren ruhig im licht des morgens während sie gingen"
    rows = [(i, f"{en if i % 2 else de} {i}", "en" if i % 2 else "de", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "12 34 !!", None, 1), (None, en, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, found int")
    model = langid.train_on_documents(df)
    assert model.langs == ["de", "en"]
    got = collect(langid.identify(df, model).select("row.doc_id", "row.lang", "found.lang_pred", "found.score"))
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (100, 101):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == r["lang"] and 0.5 <= r["score"] <= 1
    blind = langid.identify(df, langid.train_on_documents(empty)).select("found.lang_pred").distinct().collect()
    assert [r[0] for r in blind] == ["und"]


def test_lattice_sums_all_segmentations():
    from corpusflow.llm import lattice
    pieces = ["a", "b", "ab", "ba", "aba"]
    trie, w = lattice.PieceTrie(pieces), np.log([0.3, 0.2, 0.2, 0.2, 0.1])
    p = dict(zip(pieces, np.exp(w)))

    def ways(t):
        return 1.0 if not t else sum(p[t[:k]] * ways(t[k:]) for k in range(1, min(3, len(t)) + 1) if t[:k] in p)

    some = ["a", "ab", "ababa", "bbaab", "", "a" * 300]
    for scaled in (False, True):
        got = lattice.log_marginals(trie, w[:, None], some, -9.0, scaled)[:, 0]
        assert np.allclose(got[:5], [math.log(ways(t)) for t in some[:5]])
        assert got[5] == pytest.approx(300 * math.log(0.3))
    assert lattice.log_marginals(trie, w[:, None], ["z"], -9.0)[0, 0] == -9.0
    counts = lattice.expected_counts(trie, w, ["ab"], np.array([2.0]), -9.0)
    z = p["a"] * p["b"] + p["ab"]
    assert np.allclose(counts[:3], [2 * p["a"] * p["b"] / z, 2 * p["a"] * p["b"] / z, 2 * p["ab"] / z])


def test_lm_score(docs, empty):
    train = common.F.col("doc_id") % 3 != 0
    got = collect(lm_score.score_texts(docs, train, head_words=20))
    rows = collect(docs.select("doc_id", "text"))
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    c = Counter(w for r in rows if r["doc_id"] is not None and r["doc_id"] % 3 for w in cut(r["text"]))
    n, v = sum(c.values()), len(c)
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, len(cut(r["text"])),
                   sum(c[w] > 0 for w in cut(r["text"])), n,
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in cut(r["text"])), 6)) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"],
                   round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score_texts(empty, train).count() == 0


# 8, 9, 10 ------------------------------------------------------------------

@pytest.mark.parametrize("max_bytes", [16 << 20, 16])
def test_line_dedup(docs, empty, max_bytes):
    """A filter far too small only makes more suspects."""
    out = line_dedup.dedup_lines(docs, max_filter_bytes=max_bytes)
    rows = collect(docs.select("doc_id", "text"))
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\r\x0b\x0c"))
    held: dict = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if len(key(x)) >= 40 and r["doc_id"] is not None:
                held.setdefault(key(x), set()).add(r["doc_id"])
    gone = {k: max(d) for k, d in held.items() if len(d) >= 5}
    assert gone
    want = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == r["doc_id"]]
        want.append((str(r["doc_id"]), "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = collect(out.select("row.doc_id", "kept.text", "kept.n_lines", "kept.n_dropped"))
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got) == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0


def brute_components(rows, k):
    sets = [near_dup.shingle_set(t.encode() if t else None, k) for _, t in rows]
    comp = {d: d for d, _ in rows}
    again = True
    while again:
        again = False
        for (a, _), x in zip(rows, sets):
            for (b, _), y in zip(rows, sets):
                common_ = len(np.intersect1d(x, y))
                if len(x) and len(y) and 100 * common_ >= 80 * (len(x) + len(y) - common_) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    again = True
    return comp


def test_near_duplicates_of_a_large_group(spark, docs, empty, monkeypatch):
    """Copies with a few words changed each: many pairs just miss the threshold,
    so the links between components must be found, also across blocks."""
    monkeypatch.setattr(near_dup, "_BLOCK", 16)
    rng, base = random.Random(5), words(120, 7).split()
    rows = []
    for i in range(90):
        w = list(base)
        for p in rng.sample(range(120), 2 + i % 5):
            w[p] = f"new{i}x{p}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, t) for i, t in enumerate(texts())] + [(300, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", common.F.lit(1))
    got = {r["doc_id"]: r for r in collect(near_dup.near_duplicates(df, k=4))}
    want = brute_components(rows, 4)
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(r["kept"] == (d == want[d]) for d, r in got.items())
    assert got[208]["n_shingles"] == 0 and got[212]["n_shingles"] == 1
    assert near_dup.near_duplicates(empty).count() == 0


def test_drop_near_duplicates_keeps_one_of_each(docs):
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(3) == 1 and 14 not in ids and 0 in ids and None in ids and 8 in ids and 9 in ids


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5), (7, 8), (8, 7)]
    comp = {n: n for e in edges for n in e}
    for _ in comp:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r["node"]: r["root"] for r in collect(connected_components(spark.createDataFrame(edges, "u long, v long")))}
    assert got == {n: r for n, r in comp.items() if n != r}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [250_000, 7])
def test_decontamination(spark, docs, empty, block):
    long_item = " ".join(texts()[2].split()[5:25])
    bench = spark.createDataFrame([(1, long_item), (2, "two"), (3, None), (4, "..."), (None, "one"), (5, long_item),
                                   (10, "All rights")], "item_id long, text string").withColumn("h", common.F.lit(1))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(
        str.maketrans(common.UPPER, common.LOWER)))
    windows = {}
    for i, t in ((1, long_item), (2, "two"), (5, long_item), (10, "All rights")):
        w, n = cut(t), min(13, len(cut(t)))
        for a in range(len(w) - n + 1):
            windows.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    want = []
    for r in collect(docs.select("doc_id", "text").distinct()):
        w, hit, items = cut(r["text"]), set(), set()
        for win, who in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a:a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    items |= who
        want.append((str(r["doc_id"]), len(w), len(hit), ",".join(sorted(items))))
    got = collect(decontam.contamination(docs, bench, block_windows=block))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got) == sorted(want)
    assert {r["n_rows"] for r in got if r["doc_id"] == 3} == {3}
    kept = decontam.decontaminate(docs, bench, block_windows=block)
    bad = {d for d, n, h, _ in want if h and 20 * h >= n}
    assert kept.columns == docs.columns and bad and not bad & {str(r.doc_id) for r in kept.collect()}
    assert kept.count() == sum(str(r.doc_id) not in bad for r in docs.select("doc_id").collect())
    cut_out = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "spans", block_windows=block).collect()}
    assert cut_out[2].split() == [w for i, w in enumerate(texts()[2].split()) if not 5 <= i < 25]
    assert cut_out[12] == "one" and cut_out[8] is None and cut_out[4] == texts()[4]
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).agg({"n_hit": "max"}).first()[0] == 0
