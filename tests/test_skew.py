"""NULL join keys are spread over the shuffle, not piled on one reducer."""

from pyspark.sql import functions as F

from ledgerscope.operators.joins import dimension_join


def test_null_keys_spread_across_partitions(spark):
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 20000
        # half the transactions carry no plan id (a third or more is the norm)
        fact = spark.range(n).select(
            F.col("id").alias("transaction_id"),
            F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("plan_id"))
        dim = spark.range(50).select(F.col("id").alias("p_id"), (F.col("id") * 10).alias("p_user_id"))
        joined = dimension_join(fact, "plan_id", dim, "p_id", small=False, spread_by="transaction_id")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("pid")).count().collect()]
        assert sum(sizes) == n
        assert max(sizes) < 0.2 * n          # without the salt one partition holds >= 50%
        matched = joined.filter(F.col("plan_id").isNotNull())
        assert matched.filter(F.col("p_user_id") != F.col("plan_id") * 10).count() == 0
        assert matched.count() == n // 2
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
