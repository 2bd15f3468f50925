"""Readers and writers on files written into a scratch folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from corpusflow.functions.arrays import empty_input_default
from corpusflow.operators import labels as L, vocab as V
from corpusflow.sources import readers as R, sinks as K


def _scratch():
    return tempfile.mkdtemp(prefix="corpusflow-src-")


def test_jsonl_dir_quarantine_and_order(spark):
    root = _scratch()
    os.makedirs(f"{root}/b/c")
    lines = ['{"text": "' + "x" * 120 + '", "k": 1}', '{"text": "' + "y" * 130 + '", "extra": {"a": 2}}', "",
             "{bad", '{"text": 5}', '{"id": 1}', "[1,2]"]
    with open(f"{root}/a.jsonl", "w") as f:
        f.write("\n".join(lines) + "\n")
    with open(f"{root}/b/c/z.jsonl", "w") as f:
        f.write('{"text": "' + "x" * 120 + '"}\n')
    docs, bad = R.read_jsonl_dir(spark, root)
    rows = sorted((r["doc_ord"], r["text"]) for r in docs.collect())
    assert [t for _, t in rows] == ["x" * 120, "y" * 130, None, None, "x" * 120]
    assert sorted(r["value"] for r in bad.collect()) == ["[1,2]", "{bad"]
    from corpusflow.plans.corpus import preprocess_corpus
    out = preprocess_corpus(docs.where(F.col("text").isNotNull()), order="doc_ord", dedup_mode="document")
    assert sorted(r["text"] for r in out.collect()) == ["x" * 120, "y" * 130]


def test_read_by_extension_and_discover(spark):
    root = _scratch()
    with open(f"{root}/a.tsv", "w") as f:
        f.write("only\n1\n")
    with open(f"{root}/b.json", "w") as f:
        json.dump([{"tweet": "hello", "class": "hate"}, {"tweet": "bye", "class": "none"}], f)
    assert R.read_table_by_extension(spark, f"{root}/a.tsv").columns == ["only"]
    assert sorted(R.read_table_by_extension(spark, f"{root}/b.json").columns) == ["class", "tweet"]
    out, info = R.discover_table(spark, root, L.normalize_labelled)
    assert info["path"].endswith("b.json") and info["attempts"][0]["error"] == "fewer than two columns"
    assert sorted((r["text"], r["label"]) for r in out.collect()) == [("bye", 0), ("hello", 1)]
    with pytest.raises(ValueError):
        R.read_table_by_extension(spark, f"{root}/x.parquet")


def test_sorted_paths(spark):
    root = _scratch()
    for p in ["a/b.csv", "a.b/a.csv", "a-c.csv"]:
        os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True)
        open(f"{root}/{p}", "w").write("x,y\n1,2\n")
    got = [r["path"].split(root)[-1] for r in R.list_files(spark, root).collect()]
    assert got == sorted(got, key=lambda p: p.split("/"))


def test_resolve_text_column(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert R.resolve_text_column(df) == "s" and R.resolve_text_column(df, "n") == "n"
    with pytest.raises(ValueError):
        R.resolve_text_column(spark.createDataFrame([(1,)], "n int"))


def test_fallback_rules(spark):
    p = spark.createDataFrame([(i, f"t{i}") for i in range(150)], "id long, text string")
    f = spark.createDataFrame([(1, "fb")], "id long, text string")
    assert R.with_fallback_source(p, f)[1] is False
    assert R.with_fallback_source(p, f, max_samples=50, order="id")[1] is True       # cap applied first
    assert R.with_fallback_source(p, f, max_samples=50, order="id", disable_fallback=True)[1] is False


def test_collect_texts_latin1_and_preferred(spark):
    root = _scratch()
    with open(f"{root}/a.txt", "wb") as f:
        f.write("caf\xe9 au lait ok\n\n  short \nline two is long\n".encode("latin-1"))
    with open(f"{root}/b.jsonl", "w") as f:
        f.write('{"body": "preferred text here", "other": "not this one at all"}\n{"x": "fallback value text"}\n')
    got = sorted(r["text"] for r in R.collect_texts(spark, root, min_chars=10, preferred_field="body").collect())
    assert got == ["café au lait ok", "fallback value text", "line two is long", "preferred text here"]


def test_vocab_round_trip_and_csv(spark):
    root = _scratch()
    docs = spark.createDataFrame([(0, 'say "hi"\nthere', 1)], "doc_id long, text string, label int")
    V.save_vocab(V.build_word_vocab(docs), f"{root}/vocab", max_len=8)
    assert {r["token"]: r["id"] for r in V.load_vocab(spark, f"{root}/vocab").collect()}["there"] == 4
    K.write_csv(docs.select("text", "label"), f"{root}/csv")
    back = R.read_labelled(spark, f"{root}/csv")
    assert back.first()["text"] == 'say "hi"\nthere'


def test_empty_input_default(spark):
    df = spark.createDataFrame([("  ", [0.2, 0.8]), ("x", [0.2, 0.8])], "text string, p array<double>")
    assert [r[0] for r in df.select(empty_input_default("text", "p")).collect()] == [[1.0, 0.0], [0.2, 0.8]]
    with pytest.raises(Exception):
        df.select(empty_input_default("text", "p", mode="error")).collect()


def test_dedup_within_watermark(spark):
    import datetime as dt
    from corpusflow.streaming.dedup import dedup_within_watermark
    root = _scratch()
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(seconds=i), "x" * 120 if i % 2 else "y" * 120) for i in range(6)]
    spark.createDataFrame(rows, "ts timestamp, text string").write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/in")
    q = (dedup_within_watermark(stream, "ts", "1 hour").writeStream.format("parquet")
         .option("checkpointLocation", f"{root}/ckpt").option("path", f"{root}/out")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    assert sorted(r["text"][0] for r in out.collect()) == ["x", "y"]


def test_lines_that_strict_parsers_refuse(spark, tmp_path):
    from corpusflow.sources import readers as R, sinks as K
    lines = ['{"text":"one","score":NaN}', '{"text":"two","text":"three"}', '{"text":"four"}', "", "[1, NaN]", '{"text": oops}',
             '{"deep":{"x":[1,Infinity,"é"]},"text":5}', '{"no_text":null,"big":123456789012345678901234567890}']
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "b.jsonl").write_text("\n".join(lines[:4]) + "\n", encoding="utf-8")
    (tmp_path / "in" / "sub" / "a.jsonl").write_text("\n".join(lines[4:]), encoding="utf-8")
    docs, broken = R.read_jsonl_dir(spark, str(tmp_path / "in"))
    got = docs.orderBy("doc_ord").collect()
    assert [(r["doc_ord"], r["text"]) for r in got] == [(0, "one"), (1, "three"), (2, "four"), (5, None), (6, None)]
    assert [r["value"] for r in broken.orderBy("doc_ord").collect()] == lines[4:6]
    K.write_variant_jsonl(docs.withColumn("text", F.lit("new")), str(tmp_path / "out"))
    back = [json.loads(x) for f in sorted((tmp_path / "out").glob("*.txt")) for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(back) == 5 and all(x["text"] == "new" for x in back)
    assert sorted(k for x in back for k in x) == sorted(["text", "score", "text", "text", "deep", "text", "no_text", "big", "text"])
    nan = next(x for x in back if "score" in x)["score"]
    assert nan != nan and next(x for x in back if "deep" in x)["deep"] == {"x": [1, float("inf"), "é"]}
    assert next(x for x in back if "big" in x)["no_text"] is None


def test_tables_of_many_parts(spark):
    root = _scratch() + "/x.csv/in"
    rows = spark.createDataFrame([(f"t{i}", i % 2) for i in range(40)], "text string, label int").repartition(4)
    rows.select("text").write.json(f"{root}/a.jsonl")
    rows.write.option("header", True).csv(f"{root}/b/c.csv")
    out, info = R.discover_table(spark, f"file://{root}/", L.normalize_labelled)
    assert info["path"].endswith("/b/c.csv") and len(info["attempts"]) == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_by_slices_bounds_what_is_held():
    import pyarrow as pa
    from corpusflow.functions.arrays import by_slices
    seen = []
    texts = pa.array(["x" * 40, None, "y" * 500, "z", ""])
    out = by_slices(lambda a, b: (seen.append(len(a)), pa.array([str(x) + str(y) for x, y in zip(a.to_pylist(), b.to_pylist())]))[1],
                    texts, pa.array(range(5)), size=50)
    assert out.to_pylist() == [str(x) + str(i) for i, x in enumerate(texts.to_pylist())] and seen == [2, 1, 2]
    assert by_slices(lambda a: a, texts.slice(0, 0)).to_pylist() == []


def test_objects_are_stored_once(spark, monkeypatch):
    stored, store = {}, R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, name: stored.setdefault(name, store(df, name)))
    root = _scratch()
    open(f"{root}/a.jsonl", "w").write('{"text": "a"}\n[1]\n{"text": NaN}\nbroken\n')
    docs, broken = R.read_jsonl_dir(spark, root)
    assert [r["value"] for r in stored["jsonl-ingest"].orderBy("doc_ord").collect()] == [None, "[1]", '{"text": NaN}', "broken"]
    assert docs.count() == 2 and sorted(r["value"] for r in broken.collect()) == ["[1]", "broken"]
