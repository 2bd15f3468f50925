
import pytest

from corpusflow.functions.labels import to_binary_label
from corpusflow.operators import labels as L, sampling as S, stats


def _py_to_binary(val):
    """The reference's rules, transcribed as a test oracle from the semantics."""
    if isinstance(val, bool):
        return int(val)
    if isinstance(val, (int, float)):
        try:
            return 1 if int(val) >= 1 else 0
        except Exception:
            return 0
    if isinstance(val, str):
        s = val.strip().lower()
        if any(t in s for t in ["hate", "hatespeech", "hate_speech", "toxic", "offensive", "abusive", "insult", "hs"]):
            return 1
        if any(t in s for t in ["not_hate", "non-toxic", "clean", "neutral", "normal", "nonhate", "non-hate", "no"]):
            return 0
        if s in {"none", "neutral", "clean"}:
            return 0
        if s.isdigit():
            return 1 if int(s) >= 1 else 0
    return 0


def test_binary_labels_strings(spark):
    vals = ["HS", "Offensive lang", "not_hate", "non-toxic", " Neutral ", "2", "0", "1.0", "yes", None, "hate"]
    df = spark.createDataFrame([(v,) for v in vals], "l string")
    got = [r[0] for r in df.select(to_binary_label(df, "l")).collect()]
    assert got == [_py_to_binary(v) for v in vals]
    assert got[2] == 1 and got[3] == 1           # substring quirk kept


def test_binary_labels_numeric_bool(spark):
    df = spark.createDataFrame([(0.5,), (-3.0,), (float("nan"),), (2.0,), (1.0,), (None,)], "l double")
    assert [r[0] for r in df.select(to_binary_label(df, "l")).collect()] == [0, 0, 0, 1, 1, 0]
    b = spark.createDataFrame([(True,), (False,)], "l boolean")
    assert [r[0] for r in b.select(to_binary_label(b, "l")).collect()] == [1, 0]


def test_strict_mode(spark):
    df = spark.createDataFrame([("not_hate",)], "l string")
    assert df.select(to_binary_label(df, "l", strict=True)).first()[0] == 0


def test_infer_columns(spark):
    df = spark.createDataFrame([("x", "hate", 1), ("y", "none", 2)], "tweet string, class string, n int")
    out, d = L.normalize_labelled(df)
    assert (d["text_col"], d["label_col"]) == ("tweet", "class")
    assert [r["label"] for r in out.collect()] == [1, 0]
    df2 = spark.createDataFrame([(f"t{i}", i % 3, i) for i in range(20)], "words string, grp int, id int")
    assert L.infer_text_label_columns(df2)["label_col"] == "grp"
    with pytest.raises(ValueError):
        L.infer_text_label_columns(spark.createDataFrame([(i,) for i in range(20)], "n int"))


@pytest.mark.parametrize("n,ratios,expected", [(399, (.8, .1, .1), (319, 39, 41)), (3, (.8, .1, .1), (1, 1, 1)),
                                               (3, (.4, .3, .3), (1, 1, 1))])
def test_split_counts(n, ratios, expected):
    assert S.split3_counts(n, ratios) == expected


def test_split_errors():
    with pytest.raises(ValueError):
        S.split3_counts(2, (.8, .1, .1))
    with pytest.raises(ValueError):
        S.validate_split_ratios((.8, .2, 0))
    assert S.split2_tail_counts(10, .1) == (9, 1)
    with pytest.raises(ValueError):
        S.split2_tail_counts(1, .5)
    assert S.split2_head_counts(10, .1) == (9, 1)
    assert S.split2_head_counts(1, .1) == (1, 0)
    assert S.split2_head_counts(10, 0) == (10, 0)


def test_split3_exact_sizes_and_order(spark):
    import hashlib
    df = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    out = S.split3(df, (.8, .1, .1), seed=42)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 800, "validation": 100, "test": 100}
    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    want = {i: ("train" if k < 800 else "validation" if k < 900 else "test") for k, i in enumerate(order)}
    assert {r["doc_id"]: r["split"] for r in out.collect()} == want


def test_kth_drilldown_matches_sort(spark, monkeypatch):
    import hashlib
    monkeypatch.setattr(S, "_FINAL_ROWS", 10)     # force several drill-down levels
    df = spark.range(0, 3000).withColumnRenamed("id", "doc_id")
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
    cuts = S.cut_points(df, "doc_id", 7, [0, 1, 1500, 2999])
    assert {p: c[1] for p, c in cuts.items()} == {0: order[0], 1: order[1], 1500: order[1500], 2999: order[2999]}


def test_sample_n(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "doc_id")
    assert S.sample_n(df, 37, seed=3).count() == 37
    assert S.sample_n(df, 900, seed=3).count() == 500


def test_dataset_stats(spark):
    df = spark.createDataFrame([("a", 0, "train"), ("bbb", 1, "train"), ("cc", 1, "test"), ("dddd", None, "test")],
                               "text string, label int, split string")
    s = {r["split"]: r for r in stats.dataset_stats(df).collect()}
    assert s["combined"]["total_rows"] == 4 and s["combined"]["median_text_length"] == 2.5
    assert s["train"]["avg_text_length"] == 2.0
    c = {(r["split"], r["label"]): r for r in stats.class_breakdown(df).collect()}
    assert c[("test", 1)]["class_pct"] == 50.0 and c[("combined", 1)]["class_count"] == 2
    assert ("test", None) not in c


def test_label_ids_and_unseen(spark):
    train = spark.createDataFrame([("10",), ("9",), ("10",)], "label string")
    m = L.label_ids(train)
    assert [(r["label_str"], r["label_id"]) for r in m.orderBy("label_id").collect()] == [("10", 0), ("9", 1)]
    with pytest.raises(ValueError):
        L.apply_label_ids(spark.createDataFrame([("7",)], "label string"), m)
    with pytest.raises(ValueError):
        L.label_ids(spark.createDataFrame([("1",)], "label string"))
