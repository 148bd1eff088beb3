"""The stages against plain versions of themselves on a small table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_pipeline_of_awkward_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, bits int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    rows = [(1, long, "en", None, None, "x", 1), (1, long, "en", None, None, "x", 1), (None, "a b c", None, None, None, None, None), (2, None, None, None, None, None, None), (3, "", None, None, None, None, None), (4, long + " end", "en", None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(rows), name
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {1, None}


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("aehinorst", k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(30)]
    passage = " ".join(rng.choices(words, k=60))
    texts += [texts[0], texts[1] + " extra", None, "12 34", f"{texts[2][:300]} {passage}", f"{texts[3][:200]} {passage} tail", 'a token = "' + "0123456789abcdef" * 3 + '" here ' + texts[4][:250]]
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    own = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        own = spark.createDataFrame(stage(spark, own, str(tmp_path)).collect(), docs.schema)
        kept.append({r["doc_id"]: r for r in own.collect()})
        assert own.columns == docs.columns, name
    assert set(kept[0]) == set(range(37)) - {32, 33}
    assert set(kept[1]) == set(kept[0]) - {30, 31}
    assert passage in kept[2][34]["text"] and passage not in kept[2][35]["text"] and kept[2][5]["text"] == texts[5]
    assert "[SECRET]" in kept[3][36]["text"] and all(r["n_chars"] == len(r["text"]) for r in kept[3].values())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept[3])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
