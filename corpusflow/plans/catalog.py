"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator, each reading the driver's tables over their whole extent.

Numbers are rounded to 9 decimals where floating-point summation order could
differ from the oracle's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from corpusflow.functions import text as T
from corpusflow.functions.arrays import argmax, confidence, softmax, threshold_label
from corpusflow.functions.labels import to_binary_label
from corpusflow.functions.urls import normalize_url as _normalize_url, url_host as _url_host
from corpusflow.operators import bpe as B, dedup, labels as L, lm as LM, metrics as M, ml as ML
from corpusflow.operators import sampling as S, sequences as Q, stats, vocab as V, web as W
from corpusflow.operators.ml import pool_vectors
from corpusflow.plans.corpus import preprocess_corpus, preprocess_report
from corpusflow.plans.fixtures import labelled, predictions, step_log, table
from corpusflow.session import checkpoint_dir, materialize
from corpusflow.sources import readers as R, sinks as K
from corpusflow.streaming.dedup import run_stream_dedup

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r(c, digits: int = 9):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# ------------------------------------------------------------------ corpus

@register("preprocess_corpus")
def q_preprocess_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess_corpus(table(spark, sf, "documents"), min_length=100,
                             dedup_mode="paragraph", sequence_min_len=50)


@register("preprocess_corpus_document")
def q_preprocess_document(spark, sf):
    return preprocess_corpus(table(spark, sf, "documents"), min_length=100, dedup_mode="document")


@register("dedup_documents")
def q_dedup_documents(spark, sf):
    return dedup.dedup_documents(table(spark, sf, "documents")).select("doc_id", "source")


@register("dedup_paragraphs")
def q_dedup_paragraphs(spark, sf):
    out = dedup.dedup_paragraphs(table(spark, sf, "documents"), sequence_min_len=50)
    return out.select("doc_id", F.length("text").cast("bigint").alias("n_chars_out"), F.md5("text").alias("text_md5"))


@register("reduction_report")
def q_reduction_report(spark, sf):
    return preprocess_report(table(spark, sf, "documents"))


@register("distinct_keep_first")
def q_distinct_keep_first(spark, sf):
    docs = table(spark, sf, "documents")
    return dedup.distinct_keep_first(docs.select("doc_id", "text")).select("doc_id")


@register("clean_texts")
def q_clean_texts(spark, sf):
    conv = table(spark, sf, "conversations")
    c = T.clean_text("text", 15)
    return conv.select("conv_id", "turn", c.alias("text")).where(F.col("text").isNotNull()) \
        .select("conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("content_hash")
def q_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash("text").alias("hash"))


@register("collapse_whitespace")
def q_collapse_whitespace(spark, sf):
    docs = table(spark, sf, "documents")
    c = T.collapse_whitespace("text")
    return docs.select("doc_id", F.length(c).cast("bigint").alias("n_chars"), F.md5(c).alias("text_md5"))


@register("filter_min_length")
def q_filter_min_length(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.where(T.is_long_enough("text", 200)).select("doc_id", "lang")


# ------------------------------------------------------------------ labels / stats / splits

@register("labelled_documents")
def q_labelled(spark, sf):
    return labelled(spark, sf).select("doc_id", "label", F.length("text").cast("bigint").alias("n_chars"))


@register("to_binary_label")
def q_to_binary(spark, sf):
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id")
    lab = lab.withColumn("toxic_str", F.col("toxic").cast("string")) \
             .withColumn("quality_dbl", F.col("quality").cast("double") * 1.5)
    return lab.select("doc_id",
                      to_binary_label(lab, "toxic").alias("from_int"),
                      to_binary_label(lab, "toxic_str").alias("from_str"),
                      to_binary_label(lab, "quality_dbl").alias("from_double"),
                      to_binary_label(lab, "source").alias("from_source"),
                      to_binary_label(lab, "lang").alias("from_lang"))


@register("split3")
def q_split3(spark, sf):
    return S.split3(labelled(spark, sf), (0.8, 0.1, 0.1), seed=42).select("doc_id", "split")


@register("split2_tail")
def q_split2_tail(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.split2_tail(docs, 0.1, seed=42).select("doc_id", "split")


@register("split2_head")
def q_split2_head(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.split2_head(docs, 0.1, seed=42).select("doc_id", "split")


@register("sample_n")
def q_sample_n(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return S.sample_n(docs, 100, seed=7)


@register("combine_and_split")
def q_combine_and_split(spark, sf):
    first = S.split3(labelled(spark, sf), (0.7, 0.2, 0.1), seed=7) \
        .select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uid"), "text", "label", "split")
    conv = table(spark, sf, "conversations")
    second = conv.select(F.concat(F.lit("conv:"), F.col("conv_id").cast("string"), F.lit(":"),
                                  F.col("turn").cast("string")).alias("uid"), "text",
                         to_binary_label(conv, "role").alias("label"))
    return S.combine_and_split([first, second], None, seed=11, id_col="uid").select("uid", "label", "split")


@register("dataset_stats")
def q_dataset_stats(spark, sf):
    sp = S.split3(labelled(spark, sf), (0.8, 0.1, 0.1), seed=42)
    return stats.dataset_stats(sp).select("split", "total_rows", _r("avg_text_length").alias("avg_text_length"),
                                          _r("median_text_length").alias("median_text_length"))


@register("class_breakdown")
def q_class_breakdown(spark, sf):
    sp = S.split3(labelled(spark, sf), (0.8, 0.1, 0.1), seed=42)
    return stats.class_breakdown(sp).select("split", "label", "class_count", _r("class_pct").alias("class_pct"))


@register("value_counts")
def q_value_counts(spark, sf):
    return stats.value_counts(table(spark, sf, "documents"), "lang")


@register("n_unique")
def q_n_unique(spark, sf):
    return stats.n_unique(table(spark, sf, "documents"), "source")


@register("source_counts")
def q_source_counts(spark, sf):
    return stats.source_counts(table(spark, sf, "documents"), "source")


@register("label_ids")
def q_label_ids(spark, sf):
    docs = table(spark, sf, "documents")
    mapping = L.label_ids(docs, "lang")
    return L.apply_label_ids(docs.select("doc_id", "lang"), mapping, "lang").select("doc_id", "label_id")


@register("label_names")
def q_label_names(spark, sf):
    docs = table(spark, sf, "documents")
    mapping = L.label_ids(docs, "lang")
    p = predictions(spark, sf).select("doc_id", (F.col("pred_b") * 3).alias("pred"))
    return L.label_names(p, mapping, "pred").select("doc_id", "label_name")


# ------------------------------------------------------------------ metrics

@register("binary_metrics")
def q_binary_metrics(spark, sf):
    p = predictions(spark, sf)
    m = M.binary_metrics(p, "label", "pred_b", ["run"])
    return m.select("run", *[_r(c).alias(c) for c in M.METRICS])


@register("accuracy")
def q_accuracy(spark, sf):
    """E12 per run, over rows that every model predicted."""
    from corpusflow.functions.arrays import valid_predictions
    p = predictions(spark, sf).where(valid_predictions("pred_a", "pred_b"))
    return M.accuracy(p, "label", "pred_b", ["run"]).select("run", _r("accuracy").alias("accuracy"))


@register("empty_input_default")
def q_empty_input_default(spark, sf):
    """First lines of utterances, blank ones among them, with the default scores."""
    from corpusflow.functions.arrays import empty_input_default
    conv = table(spark, sf, "conversations")
    head = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit(" \n"))
    share = F.length(head) / F.lit(1000.0)
    probs = empty_input_default(head, F.array(1 - share, share))
    return conv.select("conv_id", "turn", _r(probs[0]).alias("p0"), _r(probs[1]).alias("p1"))


@register("macro_metrics")
def q_macro_metrics(spark, sf):
    p = predictions(spark, sf)
    m = M.macro_metrics(p, "label", "pred_a", ["run"])
    return m.select("run", *[_r(c).alias(c) for c in M.METRICS])


@register("batched_metrics")
def q_batched_metrics(spark, sf):
    p = predictions(spark, sf).where(F.col("pred_a") != -1)
    m = M.batched_metrics(p, "label", "pred_a", "doc_id", batch_size=32, with_std=True)
    return m.select(*[_r(c).alias(c) for c in M.METRICS + [f"{x}_std" for x in M.METRICS]], "n_batches")


@register("multi_run_summary")
def q_multi_run_summary(spark, sf):
    p = predictions(spark, sf)
    per_run = M.binary_metrics(p, "label", "pred_b", ["run"]).withColumn("split", F.lit("test"))
    long = M.unpivot_metrics(per_run, ["run", "split"])
    s = M.multi_run_summary(long)
    return s.select("split", "metric", _r("mean").alias("mean"), _r("std").alias("std"), "n_runs")


@register("model_agreement")
def q_model_agreement(spark, sf):
    m = M.model_agreement(predictions(spark, sf))
    return m.select("n_samples", _r("accuracy_a").alias("accuracy_a"), _r("accuracy_b").alias("accuracy_b"),
                    "a_only_correct", "b_only_correct", "both_correct", "both_wrong")


@register("category_samples")
def q_category_samples(spark, sf):
    return M.category_samples(predictions(spark, sf)).select("doc_id", "category", "rank")


@register("top_errors")
def q_top_errors(spark, sf):
    p = predictions(spark, sf).withColumnRenamed("pred_b", "pred").withColumnRenamed("conf_b", "conf")
    return M.top_errors(p, "label", "pred", "conf").select("doc_id", "error", _r("conf").alias("conf"))


@register("softmax_scores")
def q_softmax_scores(spark, sf):
    """B13-B16 on 10-class logits from the whole 64-d embedding: logit c is
    the sum of the dimensions d with d % 10 = c."""
    emb = table(spark, sf, "embeddings")
    dims = F.size("embedding")
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.aggregate(
        F.filter(F.sequence(F.lit(0), dims - 1), lambda d: d % 10 == c), F.lit(0.0),
        lambda acc, d: acc + F.element_at("embedding", d + 1).cast("double")))
    scored = emb.select("vec_id", "label", softmax(logits).alias("p"))
    pred = argmax("p")
    p_pos, _ = threshold_label(F.element_at("p", 2))
    return scored.select("vec_id", pred.alias("pred"), _r(confidence("p", pred), 6).alias("conf"),
                         _r(F.array_max("p"), 6).alias("max_prob"), p_pos.alias("thresholded"))


@register("running_loss")
def q_running_loss(spark, sf):
    log = step_log(spark, sf).where(F.col("loss").isNotNull())
    r = M.running_loss(log, "run", "step", "loss", "n_tokens", log_interval=10)
    return r.select("run", "step_no", "step", _r("running_loss", 6).alias("running_loss"),
                    _r("running_ppl", 3).alias("running_ppl"))


@register("perplexity")
def q_perplexity(spark, sf):
    log = step_log(spark, sf).where(F.col("loss").isNotNull()).withColumn("loss", F.col("loss") / 10.0)
    r = M.weighted_loss_perplexity(log, "loss", "n_tokens", ["run"])
    return r.select("run", _r("avg_loss").alias("avg_loss"), _r("perplexity", 6).alias("perplexity"))


@register("early_stop_scan")
def q_early_stop(spark, sf):
    log = step_log(spark, sf).where(F.col("eval_accuracy").isNotNull())
    # step-level evaluation rows -> one validation score per (run, epoch): the
    # history the scan folds is bounded by the number of epochs
    hist = log.groupBy("run", "epoch").agg(F.avg("eval_accuracy").alias("val_accuracy"))
    r = M.early_stop_scan(hist, "run", "epoch", "val_accuracy", min_delta=0.05, patience=3)
    return r.select("run", _r("best_value").alias("best_value"), "best_epoch", "stop_epoch",
                    "improvements", "epochs_run")


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    log = step_log(spark, sf).where(F.col("loss").isNotNull())
    h = log.select("run", F.col("step").alias("epoch"), F.exp(F.least(F.col("loss") / 10.0, F.lit(20.0))).alias("train_perplexity"))
    r = M.best_checkpoint(h, "run", "epoch", "train_perplexity")
    return r.select("run", "best_epoch", _r("best_value", 6).alias("best_value"))


@register("melt_metrics")
def q_melt_metrics(spark, sf):
    _, ev = M.split_logs(step_log(spark, sf))
    return M.melt_metrics(ev).select("step", "Metric", _r("Score").alias("Score"))


@register("history_to_scalars")
def q_history_to_scalars(spark, sf):
    p = predictions(spark, sf).where(F.col("pred_a") != -1)
    tr = M.binary_metrics(p, "label", "pred_a", ["run"])
    va = M.binary_metrics(p, "label", "pred_b", ["run"])
    loss = p.groupBy("run").agg(F.avg(1 - F.col("conf_a")).alias("train_loss"), F.avg(1 - F.col("conf_b")).alias("val_loss"))
    hist = (loss.join(tr.select("run", F.struct(*M.METRICS).alias("train_metrics")), "run")
            .join(va.select("run", F.struct(*M.METRICS).alias("val_metrics")), "run")
            .withColumnRenamed("run", "epoch"))
    return M.history_to_scalars(hist).select("step", "tag", _r("value").alias("value"))


# ------------------------------------------------------------------ vocabularies, encoding, sequences


def _ids_str(c="ids"):
    return F.array_join(F.col(c).cast("array<string>"), " ")


def _train_vocab(spark, sf):
    sp = S.split3(labelled(spark, sf), (0.8, 0.1, 0.1), seed=42)
    return V.build_word_vocab(sp.where(F.col("split") == "train"))


def _utterances(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select((F.col("conv_id") * (1 << 31) + F.col("turn")).alias("utt_id"), "text")


@register("word_vocab")
def q_word_vocab(spark, sf):
    return V.build_word_vocab(table(spark, sf, "documents"))


@register("char_vocab")
def q_char_vocab(spark, sf):
    return V.build_char_vocab(table(spark, sf, "documents"))


@register("vocab_round_trip")
def q_vocab_round_trip(spark, sf):
    """I8: the character vocabulary saved and loaded, with its length limit."""
    path = _scratch(spark, "vocab")
    V.save_vocab(V.build_char_vocab(table(spark, sf, "documents")), path, max_len=128)
    return V.load_vocab(spark, path).select("token", "id", F.col("max_len").cast("bigint").alias("max_len"))


@register("encode_fixed")
def q_encode_fixed(spark, sf):
    enc = V.encode_fixed(labelled(spark, sf), _train_vocab(spark, sf), max_len=64)
    return enc.select("doc_id", _ids_str().alias("ids"))


@register("encode_truncated")
def q_encode_truncated(spark, sf):
    enc = V.encode_truncated(labelled(spark, sf), _train_vocab(spark, sf), max_length=16)
    return enc.select("doc_id", _ids_str().alias("ids"), F.size("ids").cast("bigint").alias("n_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("mask_sum"),
                      "label")


@register("encode_chars")
def q_encode_chars(spark, sf):
    vocab = V.build_char_vocab(table(spark, sf, "benchmark"), order="item_id")
    enc = V.encode_chars(_utterances(spark, sf), vocab, order="utt_id", add_special_tokens=True)
    return enc.select("utt_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(_ids_str()).alias("ids_md5"))


@register("decode_chars")
def q_decode_chars(spark, sf):
    utt = _utterances(spark, sf)
    vocab = V.build_char_vocab(utt, order="utt_id")
    enc = V.encode_chars(utt, vocab, order="utt_id", add_special_tokens=True)
    dec = V.decode_chars(enc, vocab, order="utt_id")
    return dec.select("utt_id", F.md5("text").alias("text_md5"))


def _corpus_stream(spark, sf):
    docs = table(spark, sf, "documents")
    return Q.word_stream(docs, V.build_word_vocab(docs))


@register("flat_token_stream")
def q_flat_token_stream(spark, sf):
    """F4 over per-document id arrays (char ids of the conversations, BOS/EOS wrapped)."""
    utt = _utterances(spark, sf)
    enc = V.encode_chars(utt, V.build_char_vocab(utt, order="utt_id"), order="utt_id", add_special_tokens=True)
    enc = materialize(enc, "encoded-utterances")       # read twice: offsets and tokens
    return Q.flat_token_stream(enc, order="utt_id")


@register("token_stream")
def q_token_stream(spark, sf):
    return _corpus_stream(spark, sf)[0]


@register("pack_blocks")
def q_pack_blocks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = V.encode_truncated(docs, V.build_word_vocab(docs).hint("shuffle_hash"), max_length=None)
    blocks = Q.pack_documents(encoded, block_size=256, stride=128)
    return blocks.select("start", F.md5(_ids_str("x")).alias("x_md5"), F.md5(_ids_str("y")).alias("y_md5"))


@register("assign_batches")
def q_assign_batches(spark, sf):
    return Q.assign_batches(labelled(spark, sf).select("doc_id"), "doc_id", 32)


@register("pad_batches")
def q_pad_batches(spark, sf):
    b = Q.assign_batches(labelled(spark, sf), "doc_id", 8)
    enc = V.encode_truncated(b, _train_vocab(spark, sf), max_length=None)
    p = Q.pad_batches(enc, "ids", "batch", max_length=48)
    return p.select("doc_id", "batch", F.md5(_ids_str("input_ids")).alias("ids_md5"),
                    F.size("input_ids").cast("bigint").alias("width"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("bigint").alias("mask_sum"))


@register("pool_vectors")
def q_pool_vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    emb = emb.withColumn("mask", F.when(F.col("vec_id") % 4 == 3, 0).otherwise(1))
    p = pool_vectors(emb, "label", "vec_id", "embedding", "mask")
    return p.select("label", "dim", *[_r(c, 6).alias(c) for c in ("masked_mean", "mean", "last")])


# ------------------------------------------------------------------ web pages


ALLOW_ENTRIES = ["example.com/en", "example.org"]
CRAWLER_AGENT = "CorpusBot/1.0"


def _pages(spark, sf):
    return table(spark, sf, "pages")


def _robots_rules(pages):
    """Robots rules per stored host, derived from the pages table: every host
    disallows ``/fr/`` for all agents; ``blog.`` hosts add a group for the
    crawler's agent that disallows ``/en/``."""
    hosts = pages.select(_url_host(F.col("url")).alias("host")).distinct()
    rule = lambda a, s, p, ok: F.struct(F.lit(a).alias("agent"), F.lit(s).alias("seq"),
                                        F.lit(p).alias("prefix"), F.lit(ok).alias("allow"))
    generic = F.array(rule("*", 1, "/fr/", False), rule("*", 2, "/", True))
    specific = F.array(rule("corpusbot", 3, "/en/", False))
    rules = F.when(F.col("host").startswith("blog."), F.concat(generic, specific)).otherwise(generic)
    return hosts.select("host", F.explode(rules).alias("r")).select("host", "r.*")


@register("normalize_url")
def q_normalize_url(spark, sf):
    return _pages(spark, sf).select("page_id", _normalize_url(F.col("url")).alias("norm_url"))


@register("url_allowed")
def q_url_allowed(spark, sf):
    rules = W.rules_frame(spark, W.parse_allow_rules(ALLOW_ENTRIES))
    pages = _pages(spark, sf).select("page_id", _normalize_url(F.col("url")).alias("url"))
    return W.allowed_urls(pages, rules, "url").select("page_id")


@register("robots_allowed")
def q_robots_allowed(spark, sf):
    pages = _pages(spark, sf)
    out = W.robots_allowed(pages.select("page_id", "url"), _robots_rules(pages), "url", CRAWLER_AGENT)
    return out.select("page_id", "robots_ok")


@register("scan_pages")
def q_scan_pages(spark, sf):
    pages = _pages(spark, sf)
    ct = (F.when(F.col("url").contains(".html"), F.lit("text/html; charset=utf-8"))
          .when(F.col("page_id") % 7 == 0, F.lit("application/json"))
          .when(F.col("page_id") % 7 == 1, F.lit("application/xhtml+xml"))
          .otherwise(F.lit("text/html")))
    return W.html_gate(pages.withColumn("content_type", ct)).select("page_id", "content_type")


@register("html_title")
def q_html_title(spark, sf):
    return W.extract_pages(_pages(spark, sf)).select("page_id", "title")


@register("html_to_text")
def q_html_to_text(spark, sf):
    ext = W.extract_pages(_pages(spark, sf))
    return ext.select("page_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("extract_links")
def q_extract_links(spark, sf):
    ext = W.extract_pages(_pages(spark, sf))
    links = ext.select("page_id", F.posexplode("links").alias("pos", "raw"))
    return links.select("page_id", "pos", _normalize_url(F.col("raw")).alias("dst"))


def _linked_pages(spark, sf):
    """The stored pages with links among them: page i also has anchors to pages
    16 i + 1 .. 16 i + 16, so that all are reached from the first within a few levels."""
    pages = _pages(spark, sf)
    parent = F.floor((F.col("page_id") - 1) / 16).cast("bigint")
    anchors = pages.where("page_id > 0").groupBy(parent.alias("page_id")).agg(
        F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("to"))
    more = F.array_join(F.transform("to", lambda t: F.concat(F.lit('<a href="'), t["url"], F.lit('"></a>'))), "")
    return pages.join(anchors, "page_id", "left").select(
        "page_id", "url", F.concat("html", F.coalesce(more, F.lit(""))).alias("html"))


@register("crawl_bfs")
def q_crawl_bfs(spark, sf):
    """C7 from the first page: every page that its parent's kept text leads to, four levels deep."""
    pages = _linked_pages(spark, sf)
    rules = W.rules_frame(spark, W.parse_allow_rules(["example.com", "example.net", "example.org"]))
    out = W.crawl_bfs(pages, pages.where("page_id = 0").select("url"), rules, max_depth=4, min_text_length=200, max_pages=None)
    return out.select("url", "depth", F.length("text").cast("bigint").alias("n_chars"))


# ------------------------------------------------------------------ language model, BPE, ML


@register("ngram_lm")
def q_ngram_lm(spark, sf):
    lp = LM.bigram_logprobs(LM.train_ngram_lm(table(spark, sf, "documents"), k=1.0))
    return lp.select("prev", "next", "count", _r("logp").alias("logp"))


@register("lm_perplexity")
def q_lm_perplexity(spark, sf):
    model = LM.train_ngram_lm(table(spark, sf, "documents"), k=1.0)
    p = LM.lm_perplexity(model, table(spark, sf, "benchmark"), key="item_id", per_document=True)
    return p.select("item_id", _r("avg_loss").alias("avg_loss"), _r("perplexity", 6).alias("perplexity"))


@register("next_token_topk")
def q_next_token_topk(spark, sf):
    top = LM.bigram_topk(LM.train_ngram_lm(table(spark, sf, "documents"), k=1.0), k=3, temperature=0.8)
    return top.select("prev", "next", _r("prob").alias("prob"))


@register("pretokens")
def q_pretokens(spark, sf):
    """Normalised, lower-cased pre-tokens of every utterance, as byte symbols."""
    toks = B.pretokens(table(spark, sf, "conversations"), lowercase=True)
    return toks.groupBy("pretoken").agg(F.count("*").alias("n")).select(
        "pretoken", "n", F.size(B.to_byte_symbols(F.col("pretoken"))).cast("bigint").alias("n_bytes"))


@register("pretoken_counts")
def q_pretoken_counts(spark, sf):
    return B.pretoken_counts(table(spark, sf, "documents"), min_frequency=2)


@register("bpe_train")
def q_bpe_train(spark, sf):
    hist = B.pretoken_counts(table(spark, sf, "documents"), min_frequency=1)
    merges, _ = B.bpe_train(hist, vocab_size=32_000, min_frequency=2)
    return merges


@register("text_classifier")
def q_text_classifier(spark, sf):
    terms = ML.with_terms(S.with_row_hash(labelled(spark, sf)))
    sp = S.split3(terms, (0.8, 0.1, 0.1), seed=42)
    model = ML.train_text_classifier(sp.where(F.col("split") == "train"))
    return ML.evaluate_splits(model, sp.where(F.col("split") != "train"))


@register("score_table")
def q_score_table(spark, sf):
    terms = ML.with_terms(S.with_row_hash(labelled(spark, sf)))
    sp = S.split3(terms, (0.8, 0.1, 0.1), seed=42)
    model = ML.train_text_classifier(sp.where(F.col("split") == "train"))
    return ML.score_table(model, terms).select("doc_id", "label", "pred", "conf")


def _letter_shares():
    """A model that is no Spark pipeline: the shares of ``a`` and ``e`` among both,
    in halves; it fails on a text that holds a ``|``, and on one without either."""
    def predict(texts):
        out = []
        for t in texts:
            if "|" in t:
                raise ValueError("this model knows no tables")
            a, e = t.count("a"), t.count("e")
            out.append([a / (a + e), e / (a + e)])
        return out

    return predict


@register("score_rows")
def q_score_rows(spark, sf):
    """J2 with any Python model: batches with a failing row cost only that row."""
    out = ML.score_rows(table(spark, sf, "documents").select("doc_id", "text"), _letter_shares)
    return out.select("doc_id", "pred", _r("conf").alias("conf"))


@register("multi_seed_runs")
def q_multi_seed_runs(spark, sf):
    long = ML.multi_seed_runs(labelled(spark, sf), seeds=(42, 43, 44, 45, 46))
    return M.multi_run_summary(long)


# ------------------------------------------------------------------ sources, sinks, streaming


def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names shared storage there)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


@register("jsonl_preprocess")
def q_jsonl_preprocess(spark, sf):
    """A2 -> D3 -> I5: the reference's flagship path, from a JSON-lines folder to
    rewritten objects (unknown keys kept), read back."""
    root = _scratch(spark, "jsonl")
    K.write_jsonl(table(spark, sf, "documents").orderBy("doc_id"), f"{root}/in")
    docs, _ = R.read_jsonl_dir(spark, f"{root}/in", glob="*.json")
    K.write_variant_jsonl(preprocess_corpus(docs, order="doc_ord"), f"{root}/out")
    out, _ = R.read_jsonl_dir(spark, f"{root}/out", glob="*.txt")
    return out.select(F.variant_get("data", "$.doc_id", "bigint").alias("doc_id"), "text",
                      F.variant_get("data", "$.lang", "string").alias("lang"),
                      F.variant_get("data", "$.source", "string").alias("source"),
                      F.variant_get("data", "$.n_chars", "bigint").alias("n_chars"))


@register("jsonl_lenient")
def q_jsonl_lenient(spark, sf):
    """A2 + I5 on lines that strict parsers refuse, one per document: NaN, repeated
    keys (the last wins), broken lines (quarantined); kept objects are rewritten
    with the text's length for text and read back."""
    root = _scratch(spark, "lenient")
    doc = F.to_json(F.struct("doc_id", "text"))
    body = F.expr("substring(line, 2, length(line) - 2)")
    kind = F.col("doc_id") % 4
    lines = table(spark, sf, "documents").withColumn("line", doc).select(
        F.when(kind == 0, F.concat(F.lit('{"score": NaN, '), body, F.lit(', "low": -Infinity}')))
        .when(kind == 1, F.concat(F.lit('{"text": "overridden", '), body, F.lit("}")))
        .when(kind == 2, F.col("line")).otherwise(F.concat(F.lit('{"text": '), body)).alias("text"))
    K.write_text(lines, f"{root}/in")
    docs, broken = R.read_jsonl_dir(spark, f"{root}/in", glob="*.txt")
    K.write_variant_jsonl(docs.withColumn("text", F.char_length("text").cast("string")), f"{root}/out")
    out, _ = R.read_jsonl_dir(spark, f"{root}/out", glob="*.txt")
    kept = out.select(F.variant_get("data", "$.doc_id", "bigint").alias("doc_id"), "text",
                      F.coalesce(F.col("source").contains("NaN") & F.col("source").contains("-Infinity"),
                                 F.lit(False)).alias("not_finite"))
    return kept.groupBy("not_finite").agg(F.count("*").alias("n"), F.sum("doc_id").alias("doc_ids"),
                                          F.sum(F.col("text").cast("bigint")).alias("chars"), F.lit(False).alias("quarantined")) \
        .unionByName(broken.select(F.lit(False).alias("not_finite"), F.lit(None).cast("bigint").alias("doc_ids"),
                                   F.char_length("value").cast("bigint").alias("chars"))
                     .groupBy("not_finite").agg(F.count("*").alias("n"), F.max("doc_ids").alias("doc_ids"),
                                                F.lit(None).cast("bigint").alias("chars"), F.lit(True).alias("quarantined")))


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """I4: split CSVs with multi-line texts written and read back."""
    root = _scratch(spark, "csv")
    sp = S.split3(labelled(spark, sf), (0.8, 0.1, 0.1), seed=42)
    K.write_csv(sp.select("doc_id", "text", "label", "split"), root, partition_by="split")
    back = spark.read.csv(root, header=True, multiLine=True, escape='"', inferSchema=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label"),
                       F.md5("text").alias("text_md5"), "split")


@register("read_labelled")
def q_read_labelled(spark, sf):
    """A1: a CSV whose columns have other names, asserted, projected and renamed."""
    root = _scratch(spark, "labelled")
    K.write_csv(labelled(spark, sf).withColumnsRenamed({"text": "tweet", "label": "hate"}), root)
    out = R.read_labelled(spark, root, "tweet", "hate")
    return out.select(F.md5("text").alias("text_md5"), F.col("label").cast("int").alias("label"))


@register("read_table_by_extension")
def q_read_table(spark, sf):
    """A3: one table written as .csv, .tsv and .jsonl and read by its extension."""
    root = _scratch(spark, "tables")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    K.write_csv(docs, f"{root}/t.csv")
    docs.write.option("header", True).option("sep", "\t").option("escape", '"').csv(f"{root}/t.tsv")
    K.write_jsonl(docs, f"{root}/t.jsonl")
    out = None
    for ext in ("csv", "tsv", "jsonl"):
        part = R.read_table_by_extension(spark, f"{root}/t.{ext}").select(
            F.lit(ext).alias("ext"), F.col("doc_id").cast("bigint").alias("doc_id"), "lang",
            F.col("n_chars").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))
        out = part if out is None else out.unionByName(part)
    return out


@register("discover_tables")
def q_discover_tables(spark, sf):
    """A4 + B1 + B2: of three candidate tables, folders of parts, the first has one
    column, the second no label; the third is normalised."""
    root = _scratch(spark, "discover")
    K.write_jsonl(table(spark, sf, "benchmark").select("text"), f"{root}/a.jsonl")
    K.write_csv(table(spark, sf, "documents").select("text", "doc_id"), f"{root}/b.csv")
    K.write_csv(labelled(spark, sf).select("text", "label"), f"{root}/c.csv")
    out, found = R.discover_table(spark, root, L.normalize_labelled)
    assert found["path"].endswith("/c.csv")
    return out.select(F.md5("text").alias("text_md5"), "label")


@register("list_files")
def q_list_files(spark, sf):
    """Files of a nested folder by path parts; its subfolders in that order."""
    root = _scratch(spark, "listing")
    table(spark, sf, "documents").select("lang", "text").write.partitionBy("lang").json(f"{root}/by")
    names = dict.fromkeys(r["path"].rsplit("/", 2)[1] for r in R.list_files(spark, root, (".json",)).toLocalIterator())
    return spark.createDataFrame([(i, n.split("=")[1]) for i, n in enumerate(names)], "pos int, lang string")


@register("resolve_text_column")
def q_resolve_text_column(spark, sf):
    """The preferred column if it is there, else the first of a string type."""
    pages = _pages(spark, sf)
    first, preferred = R.resolve_text_column(pages, "body"), R.resolve_text_column(pages, "html")
    return pages.select("page_id", F.md5(first).alias("first_md5"), F.md5(preferred).alias("preferred_md5"))


@register("collect_texts")
def q_collect_texts(spark, sf):
    """A5: .txt (conversations), .csv (benchmark) and JSON lines (documents)."""
    root = _scratch(spark, "collect")
    K.write_text(table(spark, sf, "conversations"), f"{root}/txt")
    K.write_csv(table(spark, sf, "benchmark"), f"{root}/csv")
    K.write_jsonl(table(spark, sf, "documents"), f"{root}/jsonl")
    texts = R.collect_texts(spark, root, min_chars=15, jsonl_glob="*.json")
    return texts.select(F.md5("text").alias("text_md5"))


@register("read_list")
def q_read_list(spark, sf):
    root = _scratch(spark, "list")
    K.write_text(table(spark, sf, "pages").select(F.concat(F.lit("  "), F.col("url")).alias("text")), root)
    return R.read_list(spark, root)


@register("normalize_labelled")
def q_normalize_labelled(spark, sf):
    """B1 + B2: columns found by name (``comment``, ``toxicity``) and labels converted."""
    lab = labelled(spark, sf)
    raw = lab.select("doc_id", F.col("text").alias("comment"),
                     F.when(F.col("label") == 1, F.lit("Toxic")).otherwise(F.lit("not toxic ")).alias("toxicity"))
    out, decision = L.normalize_labelled(raw)
    assert decision["text_col"] == "comment" and decision["label_col"] == "toxicity"
    return out.select(F.md5("text").alias("text_md5"), "label")


@register("with_fallback_source")
def q_with_fallback(spark, sf):
    """Benchmark texts unless fewer than 100, then documents instead."""
    primary = table(spark, sf, "benchmark").select(F.col("item_id").alias("src_id"), "text")
    fallback = table(spark, sf, "documents").select(F.col("doc_id").alias("src_id"), "text")
    chosen, _ = R.with_fallback_source(primary, fallback, min_texts=100)
    return chosen.select("src_id", F.md5("text").alias("text_md5"))


@register("load_corpus")
def q_load_corpus(spark, sf):
    """Union of three sources with per-source counts."""
    _, counts = R.load_corpus({"documents": table(spark, sf, "documents"),
                               "benchmark": table(spark, sf, "benchmark"),
                               "conversations": table(spark, sf, "conversations")})
    return counts


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    """K1: streaming length gate + hash dedup over the documents table, one file or a
    folder of files (a glob path lists either; a plain one must be a folder)."""
    base = _scratch(spark, "stream")
    schema = table(spark, sf, "documents").schema
    out = run_stream_dedup(spark, f"{sf}/{{documents.parquet}}", schema, f"{base}/out", f"{base}/ckpt", glob="*")
    return out.select("content_hash")


# ------------------------------------------------------------------ ordering, alignment, reports

@register("take_first")
def q_take_first(spark, sf):
    """The page cap / max-samples cap — first 100 documents in order."""
    return S.take_first(table(spark, sf, "documents"), 100).select("doc_id", "lang")


@register("shuffle_order")
def q_shuffle_order(spark, sf):
    """The seeded permutation as a dense position (two-level, md5 buckets)."""
    from corpusflow.operators.keys import global_position, hex_bucket, seeded_order_key
    docs = table(spark, sf, "documents").select("doc_id", seeded_order_key("doc_id", 42).alias("_k"))
    return global_position(docs, [F.col("_k"), F.col("doc_id")], hex_bucket("_k", 3), "pos").select("doc_id", "pos")


@register("align_predictions")
def q_align_predictions(spark, sf):
    """C3 + E11: two models' outputs attached to the labelled rows by key;
    model A's output lacks the rows it failed on, which get the sentinel back."""
    p = predictions(spark, sf)
    a = p.where(F.col("pred_a") != -1).select("doc_id", F.col("pred_a").alias("pred"), F.col("conf_a").alias("conf"))
    b = p.select("doc_id", F.col("pred_b").alias("pred"), F.col("conf_b").alias("conf"))
    rows = labelled(spark, sf).select("doc_id", "label")
    aligned = M.align_predictions(rows, "doc_id", a=a, b=b)
    return M.model_agreement(aligned).select("n_samples", "a_only_correct", "b_only_correct", "both_correct",
                                             "both_wrong")


@register("report_json")
def q_report_json(spark, sf):
    """The reduction report as one JSON document."""
    return K.report_row(preprocess_report(table(spark, sf, "documents")))


@register("write_report")
def q_write_report(spark, sf):
    """A report of counts written as one JSON document and read back."""
    path = _scratch(spark, "report")
    counts = {r["source"]: r["n_texts"] for r in q_load_corpus(spark, sf).collect()}
    K.write_report(spark, {"sources": counts, "note": "größer"}, path)
    return spark.read.text(path).select(
        F.get_json_object("value", "$.sources.documents").cast("bigint").alias("documents"),
        F.get_json_object("value", "$.sources.benchmark").cast("bigint").alias("benchmark"),
        F.get_json_object("value", "$.note").alias("note"))
