import math

import pytest

from corpusflow.operators import metrics as M, sequences as Q, vocab as V
from corpusflow.operators.lm import next_token_topk


def test_golden_agreement(spark):
    """The reference's one published result: 135 / 538 / 1436 / 162."""
    rows = []
    for i in range(2271):
        label = i % 2
        a_ok = i < 135 or 673 <= i < 2109
        b_ok = 135 <= i < 2109
        rows.append((i, label, label if a_ok else 1 - label, label if b_ok else 1 - label))
    df = spark.createDataFrame(rows, "doc_id long, label int, pred_a int, pred_b int")
    r = M.model_agreement(df).first()
    assert (r["n_samples"], r["a_only_correct"], r["b_only_correct"], r["both_correct"], r["both_wrong"]) == \
        (2271, 135, 538, 1436, 162)
    assert round(r["accuracy_a"], 4) == 0.6918 and round(r["accuracy_b"], 4) == 0.8692


def test_binary_and_macro_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "label int, pred int")
    b = M.binary_metrics(df).first()
    p, r = 2 / (3 + 1e-8), 2 / (3 + 1e-8)
    assert b["accuracy"] == pytest.approx(0.6) and b["precision"] == pytest.approx(p)
    m = M.macro_metrics(df).first()
    assert m["accuracy"] == pytest.approx(0.6)
    assert m["precision"] == pytest.approx((2 / 3 + 1 / 2) / 2, rel=1e-6)
    empty = M.binary_metrics(df.where("label > 5")).first()
    assert empty["accuracy"] == 0.0


def test_macro_ignores_predicted_only_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 2)], "label int, pred int")
    m = M.macro_metrics(df).first()
    assert m["recall"] == pytest.approx(0.5, rel=1e-6)


def test_early_stop_fixture(spark):
    vals = [0.50, 0.5005, 0.502, 0.501, 0.5, 0.9]
    df = spark.createDataFrame([(0, i + 1, v) for i, v in enumerate(vals)], "run int, epoch int, value double")
    r = M.early_stop_scan(df, min_delta=0.001, patience=1).first()
    assert (r["best_value"], r["best_epoch"], r["stop_epoch"], r["improvements"]) == (0.502, 3, 5, 2)


def test_perplexity_fixture(spark):
    df = spark.createDataFrame([(2.0, 1), (4.0, 3)], "loss double, n_tokens long")
    r = M.weighted_loss_perplexity(df).first()
    assert r["avg_loss"] == 3.5 and r["perplexity"] == pytest.approx(math.exp(3.5))
    big = spark.createDataFrame([(25.0, 1)], "loss double, n_tokens long")
    assert M.weighted_loss_perplexity(big).first()["perplexity"] == pytest.approx(math.exp(20))
    none = M.weighted_loss_perplexity(df.where("n_tokens > 100")).first()
    assert math.isinf(none["perplexity"])


def test_topk_ties(spark):
    df = spark.createDataFrame([("c", "t0", 3.0), ("c", "t1", 2.0), ("c", "t2", 2.0), ("c", "t3", 1.0)],
                               "prev string, next string, logp double")
    out = {r["next"]: r["prob"] for r in next_token_topk(df, k=2, temperature=1.0).collect()}
    assert set(out) == {"t0", "t1", "t2"} and sum(out.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        next_token_topk(df, k=2, temperature=0)


def test_vocab_fixture(spark):
    docs = spark.createDataFrame([(0, "Ang aso"), (1, "ang PUSA <PAD>")], "doc_id long, text string")
    vocab = V.build_word_vocab(docs)
    assert {r["token"]: r["id"] for r in vocab.collect()} == \
        {"<PAD>": 0, "<UNK>": 1, "ang": 2, "aso": 3, "pusa": 4, "<pad>": 5}
    enc = V.encode_fixed(spark.createDataFrame([(9, "aso ibon")], "doc_id long, text string"), vocab, max_len=3)
    assert enc.first()["ids"] == [3, 1, 0]


def test_char_round_trip(spark):
    text = "Ang bilis ng takbo ng panahon."
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    vocab = V.build_char_vocab(docs)
    enc = V.encode_chars(docs, vocab, add_special_tokens=True)
    assert enc.first()["ids"][0] == 2 and enc.first()["ids"][-1] == 3
    assert V.decode_chars(enc, vocab).first()["text"] == text


def test_blocks_fixture(spark):
    stream = spark.createDataFrame([(g, g) for g in range(10)], "g long, token_id long")
    blocks = {r["start"]: (r["x"], r["y"]) for r in Q.pack_blocks(stream, 4, 3).collect()}
    assert sorted(blocks) == [0, 3, 5]
    assert blocks[5] == ([5, 6, 7, 8], [6, 7, 8, 9])
    with pytest.raises(ValueError):
        Q.pack_blocks(stream.where("g < 4"), 4, 3)


def test_blocks_match_sequential(spark):
    n, b, s = 1000, 16, 7
    stream = spark.createDataFrame([(g, (g * 37) % 101) for g in range(n)], "g long, token_id long")
    got = {r["start"]: r["x"] for r in Q.pack_blocks(stream, b, s).collect()}
    toks = [(g * 37) % 101 for g in range(n)]
    max_start = n - (b + 1)
    starts = list(range(0, max_start + 1, s))
    if starts[-1] != max_start:
        starts.append(max_start)
    assert got == {st: toks[st:st + b] for st in starts}


def test_blank_documents_add_nothing_to_the_stream(spark):
    docs = spark.createDataFrame([(0, "a"), (1, ""), (2, "   "), (3, "b")], "doc_id long, text string")
    vocab = V.build_char_vocab(docs)
    enc = V.encode_chars(docs, vocab, add_special_tokens=True)
    assert [r["ids"] for r in enc.orderBy("doc_id").collect()][1] == [2, 3]
    assert [r["token_id"] for r in Q.flat_token_stream(enc).orderBy("g").collect()] == [2, 4, 3, 2, 6, 3]
    words = V.encode_truncated(docs, V.build_word_vocab(docs), max_length=None)
    assert [r["token_id"] for r in Q.flat_token_stream(words).orderBy("g").collect()] == [2, 3]


def test_char_codec_edge_cases_and_no_exchange(spark):
    docs = spark.createDataFrame([(0, "aé\U0001f600"), (1, None), (2, ""), (3, "zé")], "doc_id long, text string")
    vocab = V.build_char_vocab(docs.where("doc_id = 0"))
    enc = V.encode_chars(docs, vocab)
    assert [r["ids"] for r in enc.orderBy("doc_id").collect()] == [[4, 5, 6], [], [], [1, 5]]
    kept = V.decode_chars(enc, vocab, skip_special_tokens=False)
    assert [r["text"] for r in kept.orderBy("doc_id").collect()] == ["aé\U0001f600", "", "", "<UNK>é"]
    odd = spark.createDataFrame([(0, [2, 4, 99, 3, 0])], "doc_id long, ids array<long>")
    assert V.decode_chars(odd, vocab).first()["text"] == "a<UNK>"
    assert V.decode_chars(odd, vocab, skip_special_tokens=False).first()["text"] == "<BOS>a<UNK><EOS><PAD>"
    for df in (enc, V.decode_chars(enc, vocab)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block, stride", [(16, 7), (4, 9), (50, 50), (300, 128)])
def test_documents_packed_as_their_stream(spark, block, stride):
    """Documents of 0 to 700 ids, also far longer and far shorter than a window."""
    sizes = [3, 0, 700, 1, 1, 40, 0, 2, 333, 17]
    docs = spark.createDataFrame([(i, [i * 1000 + k for k in range(n)]) for i, n in enumerate(sizes)],
                                 "doc_id long, ids array<long>")
    tokens = [i * 1000 + k for i, n in enumerate(sizes) for k in range(n)]
    top = len(tokens) - block - 1
    want = {s: (tokens[s:s + block], tokens[s + 1:s + block + 1]) for s in {*range(0, top + 1, stride), top}}
    assert {r["start"]: (r["x"], r["y"]) for r in Q.pack_documents(docs, block, stride).collect()} == want
    stream = Q.flat_token_stream(docs)
    assert {r["start"]: (r["x"], r["y"]) for r in Q.pack_blocks(stream, block, stride).collect()} == want


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [8]), (1, [1, 2])], "batch long, ids array<bigint>")
    out = sorted((r["batch"], r["input_ids"], r["attention_mask"]) for r in Q.pad_batches(df, max_length=2).collect())
    assert out == [(0, [5, 6], [1, 1]), (0, [8, 0], [1, 0]), (1, [1, 2], [1, 1])]


def test_characters_coded_in_slices(spark):
    from pyspark.sql import functions as F
    n = V._SLICE // 1000
    df = spark.range(3 * n, numPartitions=1).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.concat(F.lit("aü😀"), F.col("id") % 7), 400)).alias("text"))
    vocab = V.build_char_vocab(df, order="id")
    enc = V.encode_chars(df, vocab, order="id", add_special_tokens=True)
    back = V.decode_chars(enc, vocab, order="id").withColumnRenamed("text", "back").join(df, "id")
    assert back.where(F.col("back") == F.coalesce("text", F.lit(""))).count() == 3 * n
    odd = spark.createDataFrame([(1, [4, 999, None]), (2, None), (3, []), (4, [2, 5, 3])], "id long, ids array<bigint>")
    assert [r["text"] for r in V.decode_chars(odd, vocab, order="id").orderBy("id").collect()] == ["a<UNK><UNK>", "", "", "ü"]
