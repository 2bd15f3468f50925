"""Plan assertions: no cartesian products or nested-loop joins anywhere, and
hot-key "first wins" steps limited before their shuffle."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

SKIP = {"multi_seed_runs", "text_classifier", "score_table", "bpe_train"}   # plans live inside Spark ML or are lists of merges


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - SKIP))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_hot_key_dedup_is_limited_before_shuffle(spark):
    from pyspark.sql import functions as F
    from corpusflow.operators import dedup
    # a third of the rows share one text
    df = spark.range(0, 3000).select(F.col("id").alias("doc_id"),
                                     F.when(F.col("id") % 3 == 0, F.lit("boiler plate")).otherwise(
                                         F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out = dedup.dedup_documents(df)
    plan = _plan(out)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert out.count() == 2001


def test_two_level_position_with_clustered_keys(spark):
    """Equal-count buckets: a dense id cluster (a third of the rows) is spread
    over many buckets, and positions still equal a global sort."""
    from pyspark.sql import functions as F
    from corpusflow.operators.keys import global_position, global_prefix_sum, with_quantile_bucket
    ids = list(range(1000)) + [10**9 + 7 * i for i in range(2000)]
    df = spark.createDataFrame([(i, i % 7) for i in ids], "k long, v long")
    b = with_quantile_bucket(df, "k", "_qb", n_buckets=32)
    sizes = [r["count"] for r in b.groupBy("_qb").count().collect()]
    assert max(sizes) < len(ids) / 8
    pos = {r["k"]: r["idx"] for r in global_position(b, [F.col("k")], F.col("_qb"), "idx").collect()}
    assert pos == {k: i for i, k in enumerate(sorted(ids))}
    pre = {r["k"]: r["off"] for r in global_prefix_sum(b, [F.col("k")], F.col("_qb"), F.col("v"), "off").collect()}
    acc, want = 0, {}
    for k in sorted(ids):
        want[k] = acc
        acc += k % 7
    assert pre == want


def test_bpe_train_learns_on_the_documents(spark, monkeypatch):
    """The registered query takes every pre-token of the documents and a vocabulary of
    32,000 (that the merges are right on documents is tested in test_bpe)."""
    from corpusflow.operators import bpe
    from corpusflow.plans.catalog import QUERIES
    seen = {}

    def look(histogram, **kw):
        seen.update(kw, words=histogram.count())
        return histogram, None

    monkeypatch.setattr(bpe, "bpe_train", look)
    QUERIES["bpe_train"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert seen == {"vocab_size": 32_000, "min_frequency": 2, "words": bpe.pretokens(docs).distinct().count()}


@pytest.mark.parametrize("name", ["text_classifier", "score_table", "multi_seed_runs"])
def test_classifiers_train_as_long_as_the_operator_does(spark, monkeypatch, name):
    from corpusflow.operators import ml
    from corpusflow.plans.catalog import QUERIES
    seen = []

    class Stop(Exception):
        pass

    def stop(**kw):
        seen.append(kw.get("max_iter", 50))
        raise Stop

    monkeypatch.setattr(ml, "classifier_pipeline", stop)
    with pytest.raises(Stop):
        QUERIES[name](spark, "/root/testdata/sf0.001")
    assert seen == [50]


def _hot_pairs(spark, n=6000):
    """A third of all bigrams follow one word."""
    from pyspark.sql import functions as F
    return spark.range(n).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, F.concat(F.lit("the w"), F.col("id").cast("string"))).otherwise(
        F.concat(F.lit("a"), (F.col("id") % 500).cast("string"), F.lit(" b"), (F.col("id") % 77).cast("string"))).alias("text"))


def test_hot_context_is_split_off(spark):
    from pyspark.sql import functions as F
    from corpusflow.operators import keys, lm
    model = lm.train_ngram_lm(_hot_pairs(spark))
    plain = model["bigrams"].join(model["contexts"].drop("n_next"), "prev")
    split = keys.join_split_hot(model["bigrams"], model["contexts"], ["prev"], "n_next")
    assert split.select(sorted(split.columns)).exceptAll(plain.select(sorted(plain.columns))).count() == 0
    assert split.count() == plain.count()
    # with broadcasts off only the cold rows are shuffled: no key with more than a thousandth of the rows
    total = model["bigrams"].count()
    cold = model["contexts"].where(F.col("n_next") * keys.HOT_SHARE <= total)
    assert "the" not in {r["prev"] for r in cold.select("prev").collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _plan(split).count("SortMergeJoin") == 1 and _plan(split).count("BroadcastHashJoin") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    left = keys.join_split_hot(model["bigrams"].select("prev"), model["contexts"].where("prev <> 'the'"), ["prev"], "n_next", "left")
    assert left.where("ctx_count is null").count() == left.where("prev = 'the'").count() > 0


def test_topk_is_cut_before_the_shuffle(spark, monkeypatch):
    from corpusflow.operators import lm
    from corpusflow.session import materialize
    plans = {}

    def look(df, name="stage"):
        plans[name] = _plan(df)
        return materialize(df, name)

    docs = _hot_pairs(spark)
    model = lm.train_ngram_lm(docs)
    want = lm.next_token_topk(lm.bigram_logprobs(model), k=3, temperature=0.8)
    monkeypatch.setattr(lm, "materialize_df", look)
    got = lm.bigram_topk(model, k=3, temperature=0.8)
    plan = plans["topk-counts"]
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    key = lambda r: (r["prev"], r["next"], round(r["prob"], 9))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    every = lm.bigram_topk(model, k=0)
    sums = every.groupBy("prev").sum("prob").collect()
    assert all(abs(r[1] - 1) < 1e-9 for r in sums) and every.count() == model["bigrams"].count()


def test_perplexity_by_pairs_equals_row_scores(spark):
    from pyspark.sql import functions as F
    from corpusflow.operators import lm
    docs = _hot_pairs(spark, 900)
    held = spark.createDataFrame([(1, "the w3 unseen a1 b1"), (2, "the the"), (3, ""), (4, None)], "doc_id long, text string")
    model = lm.train_ngram_lm(docs)
    rows = lm.score_bigrams(model, held.where("text is not null")).groupBy("doc_id").agg(F.avg("nll").alias("l")).collect()
    got = lm.lm_perplexity(model, held.where("text is not null"), per_document=True).collect()
    assert {r["doc_id"]: round(r["avg_loss"], 9) for r in got} == {r["doc_id"]: round(r["l"], 9) for r in rows}
    whole = lm.lm_perplexity(model, held.where("text is not null")).first()["avg_loss"]
    flat = lm.score_bigrams(model, held.where("text is not null")).agg(F.avg("nll")).first()[0]
    assert round(whole, 9) == round(flat, 9)


def _without_broadcasts(spark, make):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(make())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_preprocess_shuffles_texts_once(spark):
    """With broadcasts off: one join, and only its exchange of the documents holds texts."""
    from corpusflow.plans.corpus import preprocess_corpus
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for mode in ("paragraph", "document"):
        plan = _without_broadcasts(spark, lambda: preprocess_corpus(docs, dedup_mode=mode))
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 2 and "Window" not in plan


def test_distinct_texts_are_not_a_key(spark):
    from pyspark.sql import functions as F
    from corpusflow.operators import dedup
    rows = [(3, "b", 1), (1, "a", 2), (2, "a", 3), (1, "a", 4), (None, "c", 5), (5, None, 6), (4, None, 7), (7, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int")
    got = [(r["doc_id"], r["text"]) for r in dedup.distinct_keep_first(df).collect()]
    assert sorted(got, key=repr) == sorted([(3, "b"), (1, "a"), (None, "c"), (4, None), (7, "")], key=repr)
    plan = _without_broadcasts(spark, lambda: dedup.distinct_keep_first(df.withColumn("text", F.col("text"))))
    assert not [x for x in plan.splitlines() if ("hashpartitioning" in x or "Sort [" in x) and "(text" in x]


def test_many_labels(spark):
    from pyspark.sql import functions as F
    from corpusflow.operators import labels as L
    df = spark.range(200_000).select(F.concat(F.lit("l"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("label"))
    mapping = L.label_ids(df.unionByName(df.limit(1000)))
    got = mapping.agg(F.count("*"), F.min("label_id"), F.max("label_id"), F.count_distinct("label_id")).first()
    assert tuple(got) == (200_000, 0, 199_999, 200_000)
    assert mapping.where("label_id = 77").first()["label_str"] == "l0000077"
    hot = df.limit(10).unionByName(spark.range(5000).select(F.lit("l0000003").alias("label")))
    out = L.apply_label_ids(hot, mapping)
    assert out.columns == ["label", "label_id"] and out.where("label_id = 3").count() == 5001
    with pytest.raises(ValueError, match="labels without an id"):
        L.apply_label_ids(spark.createDataFrame([("new",), (None,)], "label string"), mapping)
    named = L.label_names(spark.createDataFrame([(3,), (-7,), (None,)], "pred long"), mapping)
    assert sorted(map(tuple, named.collect()), key=repr) == sorted([(3, "l0000003"), (-7, "-7"), (None, None)], key=repr)


def test_rows_scored_by_any_model(spark):
    from corpusflow.operators import ml

    def make():
        def model(texts):
            if any(t == "bad" for t in texts):
                raise RuntimeError("no")
            return [[float("nan"), 1.0] if t == "nan" else [0.5, 0.5] if t == "tie" else [0.2, 0.8] for t in texts]
        return model

    df = spark.createDataFrame([(0, "x"), (1, "bad"), (2, None), (3, "nan"), (4, "tie"), (5, "y")], "id long, text string")
    got = {r["id"]: (r["pred"], r["conf"]) for r in ml.score_rows(df, make, batch_rows=3).collect()}
    assert got == {0: (1, 0.8), 1: (-1, 0.0), 2: (-1, 0.0), 3: (-1, 0.0), 4: (0, 0.5), 5: (1, 0.8)}
    assert ml.score_rows(df.limit(0), make).count() == 0


def test_stream_dedup_reads_a_folder_of_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from corpusflow.plans.catalog import QUERIES
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = docs.where(F.length("text") >= 100).select(F.md5("text")).distinct().count()
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        got = QUERIES["stream_dedup"](spark, sf)
        assert got.count() == got.distinct().count() == want
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["stream_dedup"](spark, f"{tmp_path}/none").count() == 0


def test_list_files_lists_many_parts(spark, tmp_path, monkeypatch):
    from corpusflow.plans import catalog
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.option("maxRecordsPerFile", 50).parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    listed, inner = [], catalog.R.list_files
    monkeypatch.setattr(catalog.R, "list_files", lambda *a: (listed.append(inner(*a)), listed[0])[1])
    try:
        got = {r["pos"]: r["lang"] for r in catalog.QUERIES["list_files"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    langs = sorted(r["lang"] for r in docs.select("lang").distinct().collect())
    assert got == dict(enumerate(langs)) and listed[0].count() > len(langs)


def test_bigrams_cut_each_text_once(spark):
    """A text is split in a projection; the generator only reads the words, however often it needs them."""
    from corpusflow.operators import lm
    rows = [(1, "A b a\x1cB"), (2, ""), (3, None), (4, "<s> </s>")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.bigrams(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    seqs = {1: ["<s>", "a", "b", "a", "b", "</s>"], 2: ["<s>", "</s>"], 4: ["<s>", "<s>", "</s>", "</s>"]}
    want = [(i, p, *pair) for i, s in seqs.items() for p, pair in enumerate(zip(s, s[1:]))]
    assert sorted(map(tuple, got.collect())) == want


def test_few_held_out_pairs_leave_the_model_in_place(spark, monkeypatch):
    """The model's counts are no side of an outer join: a small held-out set is broadcast to them."""
    from corpusflow.operators import lm
    from corpusflow.session import materialize
    plans = {}

    def look(df, name="stage"):
        plans[name] = _plan(df)
        return materialize(df, name)

    model = lm.train_ngram_lm(_hot_pairs(spark, 900))
    monkeypatch.setattr(lm, "materialize_df", look)
    held = spark.createDataFrame([(1, "the w3 unseen a1 b1")], "doc_id long, text string")
    lm.lm_perplexity(model, held, per_document=True)
    assert "Exchange hashpartitioning" not in plans["held-out-counts"] and "BroadcastHashJoin" in plans["held-out-counts"]


def test_topk_ranks_a_context_once(spark, monkeypatch):
    """One cut and no further window after the stored one: logits are the model's, k = 0 too."""
    from corpusflow.operators import lm
    model = lm.train_ngram_lm(_hot_pairs(spark, 600))
    got = lm.bigram_topk(model, k=2, temperature=0.5)
    assert "Window" not in _plan(got)
    for k in (2, 0):
        want = lm.next_token_topk(lm.bigram_logprobs(model), k=k, temperature=0.5)
        key = lambda r: (r["prev"], r["next"], round(r["logit"], 9), round(r["prob"], 9))
        assert sorted(map(key, lm.bigram_topk(model, k=k, temperature=0.5).collect())) == sorted(map(key, want.collect()))


def test_pack_blocks_sorts_no_token_rows_for_the_vocabulary(spark, monkeypatch):
    """The words of all documents are looked up by hash, not sorted by word; skewed ones are split by AQE as before."""
    from corpusflow.operators import sequences
    from corpusflow.plans.catalog import QUERIES
    from corpusflow.session import materialize
    plans = {}

    def look(df, name="stage"):
        plans[name] = _plan(df)
        return materialize(df, name)

    monkeypatch.setattr(sequences, "materialize", look)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["pack_blocks"](spark, SF001)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "ShuffledHashJoin" in plans["stream-documents"] and "lambda" not in plans["stream-documents"]
