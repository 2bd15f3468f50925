"""Count-based language model (J3, J4) and next-token top-k sampling
distribution (F11).

The reference trains an autoregressive transformer; here the corpus model is
an add-k smoothed bigram model over ``lower().split()`` tokens with sentence
markers, built with two grouped counts (partial aggregation makes hot bigrams
cheap), and held-out perplexity is the token-weighted mean negative log
probability, capped as in the reference (``exp(min(loss, 20))``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import word_tokens
from corpusflow.operators.keys import join_split_hot
from corpusflow.operators.metrics import weighted_loss_perplexity
from corpusflow.session import materialize as materialize_df

# Sentence markers and the out-of-vocabulary token.
BOS, EOS, UNK = "<s>", "</s>", "<unk>"


def bigrams(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, pos, prev, next)`` for ``<s> w1 .. wn </s>`` of every document."""
    # the words are a column of their own: inside explode() a text would be cut anew for each use of them
    words = docs.select(key, word_tokens(F.col(text)).alias("_words"))
    pairs = F.arrays_zip(F.concat(F.array(F.lit(BOS)), "_words").alias("prev"),
                         F.concat("_words", F.array(F.lit(EOS))).alias("next"))
    return (words.select(key, F.posexplode(pairs).alias("pos", "bg"))
            .select(key, "pos", F.col("bg.prev").alias("prev"), F.col("bg.next").alias("next")))


def train_ngram_lm(docs: DataFrame, text: str = "text", key: str = "doc_id", k: float = 1.0,
                   materialize: bool = True) -> dict:
    """The smoothed bigram model.

    Returns ``{"bigrams": (prev, next, count), "contexts": (prev, ctx_count,
    n_next), "vocab_size": V, "k": k}``; ``V`` counts the distinct predicted tokens
    plus ``<unk>`` and is a scalar-subquery Column over the checkpointed counts,
    ``n_next`` a context's distinct successors (the rows it has in ``bigrams``).
    ``log p(next | prev) = ln((c + k) / (c_prev + k V))``."""
    bg = bigrams(docs, text, key)
    counts = bg.groupBy("prev", "next").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    if materialize:
        # the model is an artifact read by several consumers: computed once
        counts = materialize_df(counts, "bigram-counts")
    contexts = counts.groupBy("prev").agg(F.sum("count").cast("bigint").alias("ctx_count"), F.count("*").alias("n_next"))
    if materialize:
        contexts = materialize_df(contexts, "bigram-contexts")
    vocab = counts.select((F.count_distinct("next") + 1).cast("double")).scalar()
    return {"bigrams": counts, "contexts": contexts, "vocab_size": vocab, "k": float(k)}


def bigram_logprobs(model: dict) -> DataFrame:
    """``(prev, next, count, logp)`` for every observed bigram.  The successors of
    a hot context stay where they are (:func:`join_split_hot`)."""
    k, v = model["k"], model["vocab_size"]
    return (join_split_hot(model["bigrams"], model["contexts"], ["prev"], "n_next")
            .withColumn("logp", F.log((F.col("count") + k) / (F.col("ctx_count") + F.lit(k) * v))))


def _pair_nll(model: dict, pairs: DataFrame) -> DataFrame:
    """``(prev, next, n, nll)`` for distinct held-out pairs ``(prev, next, n)``:
    unseen pairs and contexts get the smoothing mass."""
    k, v = model["k"], model["vocab_size"]
    # inner joins first: in them either side can be broadcast, so few held-out pairs
    # (or a small model) leave the other side where it is
    known = pairs.select("prev", "next").join(model["bigrams"], ["prev", "next"])
    seen = materialize_df(pairs.join(materialize_df(known, "held-out-counts"), ["prev", "next"], "left"), "held-out-seen")
    rows = materialize_df(seen.groupBy("prev").agg(F.count("*").alias("_rows")), "held-out-rows")
    sizes = rows.join(rows.select("prev").join(model["contexts"].select("prev", "ctx_count"), "prev"), "prev", "left")
    scored = join_split_hot(seen, materialize_df(sizes, "held-out-contexts"), ["prev"], "_rows")
    c = F.coalesce(F.col("count"), F.lit(0)).cast("double")
    cp = F.coalesce(F.col("ctx_count"), F.lit(0)).cast("double")
    return scored.select("prev", "next", "n", (-F.log((c + k) / (cp + F.lit(k) * v))).alias("nll"))


def score_bigrams(model: dict, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per held-out bigram ``-ln p`` under the model (unseen pairs and contexts
    get the smoothing mass).  The model is looked up once per distinct pair; the
    rows of frequent pairs stay where they are."""
    bg = bigrams(docs, text, key)
    pairs = materialize_df(bg.groupBy("prev", "next").agg(F.count("*").alias("n")), "held-out-pairs")
    scored = materialize_df(_pair_nll(model, pairs), "held-out-nll")
    return join_split_hot(bg, scored, ["prev", "next"], "n").select(key, "pos", "prev", "next", "nll")


def lm_perplexity(model: dict, docs: DataFrame, text: str = "text", key: str = "doc_id",
                  per_document: bool = False) -> DataFrame:
    """Token-weighted mean loss and capped perplexity."""
    if per_document:
        pairs = bigrams(docs, text, key).groupBy(key, "prev", "next").agg(F.count("*").alias("m"))
        pairs = materialize_df(pairs, "document-pairs")
        every = materialize_df(pairs.groupBy("prev", "next").agg(F.count("*").alias("n")), "held-out-pairs")
        scored = materialize_df(_pair_nll(model, every), "held-out-nll")
        s = join_split_hot(pairs, scored, ["prev", "next"], "n").withColumnRenamed("m", "n")
        return weighted_loss_perplexity(s, "nll", "n", [key])
    pairs = bigrams(docs, text, key).groupBy("prev", "next").agg(F.count("*").alias("n"))
    return weighted_loss_perplexity(_pair_nll(model, materialize_df(pairs, "held-out-pairs")), "nll", "n", None)


def bigram_topk(model: dict, k: int = 10, temperature: float = 1.0) -> DataFrame:
    """F11 on the bigram model.  What a context's log-probabilities have in common
    (``ln(c_prev + k V)``) changes neither their order nor their softmax: both are
    taken from the stored counts, where each task keeps the k largest (and ties) of a
    context before the shuffle, and only the logits of those get the common part."""
    _check_topk(k, temperature)
    counts = model["bigrams"].select("prev", "next", F.log(F.col("count") + model["k"]).alias("_l"))
    kept = materialize_df(next_token_topk(counts, "prev", "next", "_l", k, temperature), "topk-counts")
    # n_next: at least the rows that are left of a context
    out = join_split_hot(kept, model["contexts"], ["prev"], "n_next")
    common = F.log(F.col("ctx_count") + F.lit(model["k"]) * model["vocab_size"]) / temperature
    return out.select("prev", "next", (F.col("logit") - common).alias("logit"), "prob")


def _check_topk(k: int, temperature: float) -> None:
    if temperature <= 0:
        raise ValueError("temperature must be > 0")
    if k < 0:
        raise ValueError("top_k must be >= 0")


def next_token_topk(logits: DataFrame, context: str = "prev", token: str = "next", logit: str = "logp",
                    k: int = 10, temperature: float = 1.0) -> DataFrame:
    """per context, divide logits by the temperature, keep every token
    whose value is at least the k-th largest (ties kept; ``k = 0`` keeps all),
    softmax over the kept tokens.

    On a stored table ``rank() <= k`` plans as a partial WindowGroupLimit before
    the shuffle, so a context with millions of successors ships at most k (+ ties)
    rows per map task; a table that is already partitioned by context has no such
    shuffle (for the bigram model see :func:`bigram_topk`).  With ``k = 0`` the
    denominators are grouped aggregates joined back, hot contexts by broadcast."""
    _check_topk(k, temperature)
    scaled = logits.select(context, token, (F.col(logit) / temperature).alias("_l"))
    if k > 0:
        # after the limit each context holds at most k (+ ties) rows, already
        # clustered by context: the softmax windows add no shuffle
        w = Window.partitionBy(context).orderBy(F.col("_l").desc())
        kept = scaled.withColumn("_rk", F.rank().over(w)).where(F.col("_rk") <= k).drop("_rk")
        whole = Window.partitionBy(context)
        ex = kept.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(whole)))
        ex = ex.withColumn("_den", F.sum("_e").over(whole))
    else:
        # all successors: grouped (partially aggregated) max / sum, joined back
        top = scaled.groupBy(context).agg(F.max("_l").alias("_mx"), F.count("*").alias("_n"))
        ex = join_split_hot(scaled, materialize_df(top, "context-maxima"), [context], "_n") \
            .withColumn("_e", F.exp(F.col("_l") - F.col("_mx")))
        den = ex.groupBy(context).agg(F.sum("_e").alias("_den"), F.count("*").alias("_n"))
        ex = join_split_hot(ex, materialize_df(den, "context-sums"), [context], "_n")
    return ex.select(context, token, F.col("_l").alias("logit"), (F.col("_e") / F.col("_den")).alias("prob"))
