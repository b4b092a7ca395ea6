"""The pipeline's stages on a small corpus, against what each must do."""

import random

import corpus_pipeline
from cladewise.llm import kneser_ney
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, path):
    rng = random.Random(9)
    common = ["the", "cat", "sat", "on", "a", "mat", "and", "dog", "ran"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(30, 90))), "en", f"s{i % 4}", 0) for i in range(300)]
    rows += [(300 + i, rows[i][1] + " end", "en", "s0", 0) for i in range(20)]
    rows += [(400 + i, " ".join(f"{rng.randrange(10**7)}##" for _ in range(50)), "en", "s1", 0) for i in range(20)]
    rows += [(500 + i, rows[50 + i][1] + f" more words and mail u{i}@x.org " + rows[90 + i][1], "en", "s2", 0) for i in range(10)]
    rows += [(600, None, None, None, None), (601, "", "fr", "s9", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
            assert docs.filter("n_chars <> length(text)").count() == 0
    ids = {k: sorted(r[0] for r in v.select("doc_id").collect()) for k, v in seen.items()}
    assert not set(ids["quality"]) & set(range(400, 420)) and len(set(ids["quality"]) & set(range(320))) > 310
    kept = set(ids["near_duplicates"])
    assert all(not (i in kept and 300 + i in kept) for i in range(20)) and kept <= set(ids["quality"]) and len(kept) == len(ids["near_duplicates"])
    assert ids["personal_data"] == ids["near_duplicates"]
    assert seen["personal_data"].filter("text like '%@x.org%'").count() == 0 and seen["personal_data"].filter("text like '%[EMAIL]%'").count() == len(kept & set(range(500, 510)))
    assert set(ids["mixture"]) <= kept
    assert set(ids["packing"]) == set(ids["mixture"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert run.agg(F.sum("length")).first()[0] == seen["packing"].agg(F.sum("length")).first()[0]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_trains_on_all_trusted_documents(spark, tmp_path, monkeypatch):
    n, seen = 210_000, []
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    counted = kneser_ney.count_pairs
    monkeypatch.setattr(kneser_ney, "count_pairs", lambda words, *a: seen.append(words.count()) or counted(words, *a))
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == n
    assert seen == [kneser_ney.trusted_ids(spark.read.parquet(str(tmp_path / "labels.parquet")), 3).filter("not held").count()] and seen[0] > 150_000
