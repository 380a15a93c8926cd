"""A table of many small sources that one task reads is parsed by many."""

import pytest
from pyspark.sql import functions as F

from symscape import source_queries
from symscape.sources import repository


def read_by_one_task(spark, path, template):
    key = F.col("id").cast("string")
    made = spark.range(0, 500, 1, 1).select(F.replace(F.lit(path), F.lit("§"), key).alias("path"), F.replace(F.lit(template), F.lit("§"), key).cast("binary").alias("raw"))
    return repository.files_of(made)


@pytest.mark.parametrize(("path", "template", "rows"), [("m§.ts", source_queries._WEB, 5), ("r§.mk", source_queries._MAKE, 3)])
def test_parsing_is_spread(spark, path, template, rows):
    found = repository.symbols(read_by_one_task(spark, path, template)).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).collect()
    assert sum(r.n for r in found) == 500 * rows and sum(r.files for r in found) == 500
    assert len(found) >= spark.sparkContext.defaultParallelism and max(r.files for r in found) < 125


def test_reads_are_spread(spark):
    found = repository.tokens(read_by_one_task(spark, "m§.py", "a§ = b§\n"))
    assert found.groupBy("token").agg(F.sum("n").alias("n")).where("token LIKE 'b%' AND n = 2").count() == 500
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
