from pyspark.sql import functions as F

from idledger.operators import walk


def test_positions_of_many_partitions(spark, tmp_path):
    """Uneven rows in eight files, more than one partition's worth, with adaptive execution: 0, 1, 2, ... in order."""
    rows, before = 1_500_000, spark.conf.get("spark.sql.shuffle.partitions")
    uneven = spark.range(rows).select((F.col("id") * 3 + 5).alias("seq"), F.expr("repeat('x', cast(id % 97 as int))").alias("message_id"))
    uneven.repartition(8, F.xxhash64("seq")).write.parquet(str(tmp_path / "in"))
    spark.conf.unset("spark.sql.shuffle.partitions")
    try:
        got = walk.with_positions(spark.read.parquet(str(tmp_path / "in")), start=10)
        assert tuple(got.agg(F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos"), F.count_if((F.col("pos") - 10) * 3 + 5 != F.col("seq"))).first()) == (rows, rows, 10, rows + 9, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
