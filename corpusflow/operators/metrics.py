"""Evaluation analytics: classification metrics, multi-run summaries, model
agreement, error listings, training-log scans and reshapes
(B24, B25, C3, E5-E12, F8-F10, G1, G2, I1-I3).

Every metric is a conditional aggregate (``count_if`` / ``sum(when)``) with
partial aggregation; confusion matrices are grouped first, so everything after
the first aggregate runs on a handful of rows.  Epsilon is 1e-8 in every
denominator, as in the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import clean_metric_name
from corpusflow.operators.keys import global_position, running_sums, with_quantile_bucket

EPS = 1e-8
METRICS = ["accuracy", "precision", "recall", "f1"]


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p = tp / (tp + fp + F.lit(EPS))
    r = tp / (tp + fn + F.lit(EPS))
    f1 = 2 * p * r / (p + r + F.lit(EPS))
    return p, r, f1


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                   group_by: list | None = None) -> DataFrame:
    """E5: accuracy and class-1 precision / recall / F1 (accuracy 0 when empty)."""
    g = list(group_by or [])
    lab, prd = F.col(label), F.col(pred)
    counts = (df.groupBy(*g) if g else df.groupBy()).agg(
        F.count_if(prd == lab).cast("double").alias("_correct"),
        F.count(F.lit(1)).cast("double").alias("_total"),
        F.count_if((prd == 1) & (lab == 1)).cast("double").alias("_tp"),
        F.count_if((prd == 1) & (lab == 0)).cast("double").alias("_fp"),
        F.count_if((prd == 0) & (lab == 1)).cast("double").alias("_fn"))
    p, r, f1 = _prf(F.col("_tp"), F.col("_fp"), F.col("_fn"))
    acc = F.when(F.col("_total") > 0, F.col("_correct") / F.col("_total")).otherwise(F.lit(0.0))
    return counts.select(*g, acc.alias("accuracy"), p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred", group_by: list | None = None) -> DataFrame:
    """Mean of ``pred = label``."""
    g = list(group_by or [])
    return (df.groupBy(*g) if g else df.groupBy()).agg(
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"))


def macro_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                  group_by: list | None = None) -> DataFrame:
    """Per-class precision / recall / F1 over the classes present in the
    labels (a class that is only predicted is ignored), unweighted mean, plus
    accuracy.  Works on the confusion matrix, which is tiny."""
    g = list(group_by or [])
    cm = df.groupBy(*g, F.col(label).alias("_l"), F.col(pred).alias("_p")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"))
    hit = F.col("_l") == F.col("_p")
    # each confusion cell contributes to the label's class and the prediction's class
    contrib = cm.select(*g, F.explode(F.array(
        F.struct(F.col("_l").alias("cls"), F.when(hit, F.col("_n")).otherwise(0.0).alias("tp"),
                 F.lit(0.0).alias("fp"), F.when(~hit, F.col("_n")).otherwise(0.0).alias("fn"),
                 F.col("_n").alias("support")),
        F.struct(F.col("_p").alias("cls"), F.lit(0.0).alias("tp"),
                 F.when(~hit, F.col("_n")).otherwise(0.0).alias("fp"), F.lit(0.0).alias("fn"),
                 F.lit(0.0).alias("support")))).alias("c")).select(*g, "c.*")
    per = contrib.groupBy(*g, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    p, r, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    macro = (per.where(F.col("support") > 0)
             .groupBy(*g).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1")))
    acc = cm.groupBy(*g).agg((F.sum(F.when(hit, F.col("_n")).otherwise(0.0)) / F.sum("_n")).alias("accuracy"))
    if g:
        return acc.join(macro, g).select(*g, *METRICS)
    return acc.select(F.lit(1).alias("_j"), "accuracy").join(
        macro.select(F.lit(1).alias("_j"), "precision", "recall", "f1"), "_j").select(*METRICS)


def batched_metrics(df: DataFrame, label: str = "label", pred: str = "pred", order: str = "doc_id",
                    batch_size: int = 32, with_std: bool = False, loss: str | None = None,
                    group_by: list | None = None) -> DataFrame:
    """E5 per consecutive batch of ``batch_size`` rows in ``order``,
    then the unweighted mean over batches (and population std with
    ``with_std``).  The dense row index is the two-level position (no
    single-partition window)."""
    g = list(group_by or [])
    idx = global_position(with_quantile_bucket(df, order, "_qb"), [F.col(order)], F.col("_qb"), "_idx",
                          partition_by=g or None)
    batched = idx.withColumn("_batch", F.floor(F.col("_idx") / batch_size))
    per = binary_metrics(batched, label, pred, g + ["_batch"])
    names = list(METRICS)
    if loss:
        per = per.join(batched.groupBy(*g, "_batch").agg(F.avg(loss).alias("loss")), g + ["_batch"])
        names.append("loss")
    aggs = [F.avg(m).alias(m) for m in names]
    if with_std:
        aggs += [F.stddev_pop(m).alias(f"{m}_std") for m in names]
    return (per.groupBy(*g) if g else per.groupBy()).agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("n_batches"))


def unpivot_metrics(df: DataFrame, ids: list, metrics: list | None = None,
                    name: str = "metric", value: str = "value") -> DataFrame:
    """Wide metric columns -> long ``(ids..., metric, value)``."""
    metrics = metrics or [c for c in METRICS if c in df.columns]
    return df.unpivot(ids, [F.col(m).cast("double") for m in metrics], name, value)


def multi_run_summary(long: DataFrame, keys=("split", "metric"), value: str = "value") -> DataFrame:
    """Mean and population std of each metric over runs."""
    return long.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                   F.count(F.lit(1)).cast("bigint").alias("n_runs"))


def weighted_loss_perplexity(df: DataFrame, loss: str = "loss", n: str = "n_tokens",
                             group_by: list | None = None, cap: float = 20.0) -> DataFrame:
    """Token-weighted mean loss, ``exp(min(loss, 20))``; infinity for both
    when there are no tokens."""
    g = list(group_by or [])
    agg = (df.groupBy(*g) if g else df.groupBy()).agg(
        F.sum(F.col(loss) * F.col(n)).alias("_ln"), F.sum(n).cast("double").alias("_n"))
    inf = F.lit(float("inf"))
    avg = F.when(F.coalesce(F.col("_n"), F.lit(0.0)) == 0, inf).otherwise(F.col("_ln") / F.col("_n"))
    ppl = F.when(F.coalesce(F.col("_n"), F.lit(0.0)) == 0, inf).otherwise(F.exp(F.least(avg, F.lit(cap))))
    return agg.select(*g, avg.alias("avg_loss"), ppl.alias("perplexity"))


def align_predictions(rows: DataFrame, key: str, **models: DataFrame) -> DataFrame:
    """Attach each model's ``(key, pred, conf)`` output to the evaluated
    rows by key (the reference aligns by position).  A row a model did not
    score gets the failure sentinel ``(-1, 0.0)``."""
    out = rows
    for name, preds in models.items():
        p = preds.select(key, F.col("pred").alias(f"pred_{name}"), F.col("conf").alias(f"conf_{name}"))
        out = (out.join(p, key, "left")
               .withColumn(f"pred_{name}", F.coalesce(F.col(f"pred_{name}"), F.lit(-1)))
               .withColumn(f"conf_{name}", F.coalesce(F.col(f"conf_{name}"), F.lit(0.0))))
    return out


def agreement_categories(df: DataFrame, label: str = "label", pred_a: str = "pred_a",
                         pred_b: str = "pred_b") -> Column:
    a_ok, b_ok = F.col(pred_a) == F.col(label), F.col(pred_b) == F.col(label)
    return (F.when(a_ok & ~b_ok, "a_only").when(b_ok & ~a_ok, "b_only")
            .when(a_ok & b_ok, "both_correct").otherwise("both_wrong"))


def model_agreement(df: DataFrame, label: str = "label", pred_a: str = "pred_a",
                    pred_b: str = "pred_b", sentinel: int = -1) -> DataFrame:
    """On rows where both models produced a prediction: sample count,
    both accuracies and the four-way correctness table."""
    v = df.where((F.col(pred_a) != sentinel) & (F.col(pred_b) != sentinel))
    a_ok, b_ok = F.col(pred_a) == F.col(label), F.col(pred_b) == F.col(label)
    return v.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_samples"),
        F.avg(a_ok.cast("double")).alias("accuracy_a"),
        F.avg(b_ok.cast("double")).alias("accuracy_b"),
        F.count_if(a_ok & ~b_ok).cast("bigint").alias("a_only_correct"),
        F.count_if(b_ok & ~a_ok).cast("bigint").alias("b_only_correct"),
        F.count_if(a_ok & b_ok).cast("bigint").alias("both_correct"),
        F.count_if(~a_ok & ~b_ok).cast("bigint").alias("both_wrong"))


def category_samples(df: DataFrame, label: str = "label", pred_a: str = "pred_a", pred_b: str = "pred_b",
                     order: str = "doc_id", limit: int = 20, sentinel: int = -1) -> DataFrame:
    """The first ``limit`` rows in ``order`` of each disagreement category
    and of "both wrong" ("both correct" is counted, not sampled)."""
    v = (df.where((F.col(pred_a) != sentinel) & (F.col(pred_b) != sentinel))
         .withColumn("category", agreement_categories(df, label, pred_a, pred_b))
         .where(F.col("category") != "both_correct"))
    w = Window.partitionBy("category").orderBy(order)
    return v.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_errors(df: DataFrame, label: str = "label", pred: str = "pred", conf: str = "conf",
               order: str = "doc_id", k: int = 20) -> DataFrame:
    """G1: false positives and false negatives, each the top ``k`` by
    confidence (ties by ``order``) — two TakeOrderedAndProject."""
    fp = df.where((F.col(label) == 0) & (F.col(pred) == 1)).withColumn("error", F.lit("false_positive"))
    fn = df.where((F.col(label) == 1) & (F.col(pred) == 0)).withColumn("error", F.lit("false_negative"))
    top = lambda d: d.orderBy(F.col(conf).desc(), F.col(order)).limit(k)
    return top(fp).unionByName(top(fn))


def running_loss(log: DataFrame, run: str = "run", step: str = "step", loss: str = "loss",
                 n: str = "n_tokens", log_interval: int = 10, cap: float = 20.0) -> DataFrame:
    """F8: cumulative token-weighted loss and perplexity inside each run,
    emitted every ``log_interval`` steps (steps numbered from 1 in ``step``
    order).  Positions and running sums are two-level (per-run buckets)."""
    log = with_quantile_bucket(log, step, "_qb")
    bucket = F.col("_qb")
    pos = global_position(log, [F.col(step)], bucket, "_pos", partition_by=[run])
    sums = running_sums(pos, [F.col(step)], bucket,
                        {"_cl": F.col(loss) * F.col(n), "_cn": F.col(n)}, partition_by=[run])
    avg = F.col("_cl") / F.greatest(F.col("_cn"), F.lit(1.0))
    return (sums.where((F.col("_pos") + 1) % log_interval == 0)
            .select(run, (F.col("_pos") + 1).alias("step_no"), F.col(step),
                    avg.alias("running_loss"), F.exp(F.least(avg, F.lit(cap))).alias("running_ppl")))


def early_stop_scan(history: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "value",
                    min_delta: float = 1e-3, patience: int = 100, start: float = float("-inf")) -> DataFrame:
    """the sequential best-so-far scan of a training history.

    improved iff ``v > best + min_delta``; ``best`` moves only on improvement
    (so a running max is wrong); otherwise the counter grows and training
    stops when it exceeds ``patience``.  Per run the history — one row per
    epoch, so its length is the number of epochs, not a data size — is
    gathered in epoch order and folded with ``aggregate``.  Step-level logs
    are aggregated to epochs first (see the registered query)."""
    hist = history.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"),
                                                                          F.col(value).cast("double").alias("v")))).alias("_h"))
    init = F.struct(F.lit(start).alias("best"), F.lit(None).cast("long").alias("best_epoch"),
                    F.lit(0).alias("counter"), F.lit(None).cast("long").alias("stop_epoch"),
                    F.lit(0).alias("improvements"), F.lit(0).alias("epochs_run"))

    def step(acc, x):
        stopped = acc["stop_epoch"].isNotNull()
        improved = x["v"] > acc["best"] + F.lit(min_delta)
        counter = F.when(improved, F.lit(0)).otherwise(acc["counter"] + 1)
        return F.when(stopped, acc).otherwise(F.struct(
            F.when(improved, x["v"]).otherwise(acc["best"]).alias("best"),
            F.when(improved, x["e"].cast("long")).otherwise(acc["best_epoch"]).alias("best_epoch"),
            counter.alias("counter"),
            F.when(~improved & (counter > patience), x["e"].cast("long")).alias("stop_epoch"),
            (acc["improvements"] + F.when(improved, 1).otherwise(0)).alias("improvements"),
            (acc["epochs_run"] + 1).alias("epochs_run")))

    res = hist.select(run, F.aggregate("_h", init, step).alias("s"))
    return res.select(run, F.col("s.best").alias("best_value"), F.col("s.best_epoch").alias("best_epoch"),
                      F.col("s.stop_epoch").alias("stop_epoch"), F.col("s.improvements").alias("improvements"),
                      F.col("s.epochs_run").cast("bigint").alias("epochs_run"))


def best_checkpoint(history: DataFrame, run: str = "run", epoch: str = "epoch",
                    metric: str = "train_perplexity") -> DataFrame:
    """earliest epoch with the strictly lowest value of ``metric``."""
    best = history.groupBy(run).agg(F.min(F.struct(F.col(metric).alias("v"), F.col(epoch).alias("e"))).alias("b"))
    return best.select(run, F.col("b.e").alias("best_epoch"), F.col("b.v").alias("best_value"))


def split_logs(log: DataFrame, loss: str = "loss", eval_loss: str = "eval_loss") -> tuple[DataFrame, DataFrame]:
    """Training rows (``loss`` set) and evaluation rows (``eval_loss`` set)."""
    return log.where(F.col(loss).isNotNull()), log.where(F.col(eval_loss).isNotNull())


EVAL_METRICS = ["eval_accuracy", "eval_f1", "eval_precision", "eval_recall"]


def melt_metrics(eval_log: DataFrame, step: str = "step") -> DataFrame:
    """Evaluation rows -> long ``(step, Metric, Score)`` over the metric
    columns that exist, with cleaned names (B24)."""
    present = [m for m in EVAL_METRICS if m in eval_log.columns]
    if not present:
        return eval_log.sparkSession.createDataFrame([], f"{step} bigint, Metric string, Score double")
    long = eval_log.unpivot([step], [F.col(m).cast("double") for m in present], "Metric", "Score")
    return long.withColumn("Metric", clean_metric_name(F.col("Metric")))


def history_to_scalars(history: DataFrame, epoch: str = "epoch") -> DataFrame:
    """Nested epoch history -> ``(tag, value, step)`` rows:
    ``Loss/train``, ``Loss/validation``, ``Metrics/<split>/<metric>``."""
    cols = {"Loss/train": F.col("train_loss"), "Loss/validation": F.col("val_loss")}
    for side, field in (("train", "train_metrics"), ("validation", "val_metrics")):
        for m in METRICS:
            cols[f"Metrics/{side}/{m}"] = F.col(f"{field}.{m}")
    wide = history.select(F.col(epoch).alias("step"), *[c.cast("double").alias(t) for t, c in cols.items()])
    return wide.unpivot(["step"], list(cols), "tag", "value")
