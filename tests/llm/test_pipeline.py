import hashlib

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from checks.compare import connect, difference
from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(queries.ORACLE) <= set(queries.QUERIES)


def test_queries_equal_sql(spark):
    con = connect(FOLDER)
    for name, text in queries.ORACLE.items():
        assert difference(entry.queries()[name](spark, FOLDER), con, text) is None, name


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, FOLDER).cache()
        if name != "pack":
            assert seen.columns == docs.columns
        if name == "quality":
            good = labels.filter("quality = 1").join(docs, "doc_id")
            assert good.join(seen, "doc_id").count() >= 0.99 * good.count()
            assert labels.filter("quality = 0").join(seen, "doc_id").count() <= 0.2 * labels.filter("quality = 0").count()
        elif name == "deduplicate":
            assert 0 < seen.count() < before.count() and seen.select("doc_id").distinct().count() == seen.count()
            assert seen.groupBy("text").count().filter("count > 1").isEmpty()
        elif name == "redact":
            assert seen.count() == before.count() and seen.filter(F.col("text").rlike("AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).isEmpty()
        elif name == "mix":
            assert seen.join(before, "doc_id", "left_anti").isEmpty() and seen.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        else:
            assert seen.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
            assert seen.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_run_repeats(spark):
    def digest():
        rows = corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
        return hashlib.md5(str(sorted(map(tuple, rows))).encode()).hexdigest()
    assert digest() == digest()
