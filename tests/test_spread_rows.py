"""Work of much time on each row of a compact table is that of many tasks."""

from oracle import rows_of_spark, rows_of_sql
from pyspark.sql import functions as F

from waymark import catalog_queries
from waymark.functions import extract

SF = "/root/testdata/sf0.001"


def test_fields_of_one_file_are_many_tasks(spark):
    found = catalog_queries.queries()["q_fields"](spark, SF)
    assert found.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows_of_spark(found) == rows_of_sql(catalog_queries.oracle_sql()["q_fields"], SF)


def test_distances_are_looked_for_once(spark):
    plan = spark.range(1).select(extract.distances(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Cự ly") == 1
