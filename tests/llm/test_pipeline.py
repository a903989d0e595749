import random

from pyspark.sql import functions as F

import corpus_pipeline
from ndcollect.llm import queries


def test_queries_and_sql_agree_in_names():
    names = queries.queries()
    assert sorted(n.split("_")[0] for n in names) == sorted(f"op{k}" for k in range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


def words(rng, n):
    return " ".join("".join(rng.choice(["ba", "ko", "ti", "lu", "mer"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_stages_take_effect_on_their_own_input(spark, docs_of, tmp_path):
    rng = random.Random(2)
    rows = [(i, words(rng, 80)) for i in range(120)]
    item = words(rng, 40)
    near = rows[5][1].split()
    near[40] = "edited"
    planted = [(200, rows[3][1]), (201, " ".join(near)), (202, item), (203, rows[7][1] + " " + item + " " + words(rng, 60)), (204, "12345 67890"), (205, None)]
    docs_of(rows + planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = set(range(120)) | {200, 201, 202, 203, 204, 205}
    for (name, stage), gone in zip(corpus_pipeline.STAGES, [{204, 205}, {3}, {201}, {202}, set()]):
        out = stage(spark, docs, str(tmp_path))
        left -= gone
        assert {r.doc_id for r in out.collect()} == left, name
        if name != "sentencepiece":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == left and all(r.round_trip for r in final.collect())
    assert item not in {r.doc_id: r.text for r in docs.collect()}[203]


def test_empty_tables_and_odd_rows_pass_every_stage(spark, docs_of, tmp_path):
    rng = random.Random(4)
    docs = docs_of([(i, words(rng, 60)) for i in range(40)]).withColumn("__spans", F.lit("x")).withColumn("__key", F.lit(1)).withColumn("text_key", F.lit(2))
    long = " ".join(words(rng, 1) for _ in range(40_000))
    odd = spark.createDataFrame([(100, long, "en"), (100, long, "en"), (None, long[:-1] + "x", "en"), (101, "", "en"), (102, None, None), (101, "", "en")], "doc_id long, text string, lang string")
    rows = docs.unionByName(odd, allowMissingColumns=True)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    spark.createDataFrame([(None, words(rng, 30)), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == rows.columns, name
            out.write.parquet(f"{tmp_path}/{k}")
            rows = spark.read.parquet(f"{tmp_path}/{k}")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert got == [(False, i) for i in [*range(40), 100]]  # the copy goes, the near copy without an id, and what has no letter


def test_queries_on_empty_tables(spark, tmp_path):
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
