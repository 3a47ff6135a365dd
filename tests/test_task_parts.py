"""Shuffles whose parts are dealt by a table's size."""

from pyspark.sql import functions as F

from foliant.plans.commerce import many_to_many_join
from foliant.plans.lineage import tasks


def test_parts_grow_with_the_table(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert tasks(table, 10) == 100 and tasks(table) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_repeated_keys_count_as_in_the_plain_join(spark, tmp_path):
    spark.createDataFrame([(1, "A", 10), (1, "A", 12), (2, None, 20), (3, "B", 9)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2), (None, 1), (2, 3), (5, None)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "high"), (1, "high"), (1, "low"), (2, None)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    part, line, orders = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("part", "lineitem", "orders"))
    plain = part.filter("p_size >= 10").join(line, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    want = plain.groupBy("p_brand", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("orders"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(many_to_many_join(spark, str(tmp_path))) == rows(want)
