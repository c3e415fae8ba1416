import pytest
from pyspark.sql import functions as F

from catalore.operators import skew


@pytest.fixture
def no_broadcast(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.fixture
def sides(spark):
    # A third of the left rows under one key, some without key, some unmatched.
    key = (
        F.when(F.col("id") % 3 == 0, 0)
        .when(F.col("id") % 17 == 0, F.lit(None))
        .otherwise(F.col("id") % 40)
    )
    left = spark.range(6000).select("id", key.alias("k"), F.lit("x").alias("k2"))
    right = spark.range(30).select(
        F.col("id").alias("k"), F.lit("x").alias("k2"), F.concat(F.lit("r"), "id").alias("v")
    )
    return left, right.unionByName(right.where("k < 3").withColumn("v", F.lit("again")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_the_plain_join(no_broadcast, sides, how):
    left, right = sides
    keys = ["k", "k2"]
    spread = skew.join_spread(left, right, keys, how, spread_by="id", rows_per_split=200)
    plain = left.join(right, keys, how)
    assert "_salt" in spread._jdf.queryExecution().toString()
    columns = plain.columns
    assert sorted(map(repr, spread.select(*columns).collect())) == sorted(map(repr, plain.collect()))


def test_hot_key_is_split_evenly(no_broadcast, sides):
    left, _ = sides
    hot = skew.hot_keys(left, ["k", "k2"], 200).collect()
    splits = {r["k"]: r["_splits"] for r in hot}
    assert splits[0] == 11 and None in splits  # 2000 rows and some, and the rows without key
    salts = left.where("k = 0").groupBy(F.pmod(F.xxhash64("id"), F.lit(splits[0]))).count()
    assert max(r["count"] for r in salts.collect()) < 300


def test_rows_without_a_spreading_value_are_split_too(no_broadcast, sides):
    left, right = sides
    nulls = left.withColumn("nothing", F.lit(None).cast("long"))
    spread = skew.join_spread(nulls, right, ["k", "k2"], "inner", "nothing", rows_per_split=200)
    assert spread.count() == left.join(right, ["k", "k2"]).count()
    hot = nulls.where("k = 0").groupBy(F.pmod(F.xxhash64("nothing", "id", "k", "k2"), F.lit(11))).count()
    assert hot.count() == 11


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 5)
    rows = spark.range(1000).select((F.col("id") % 50).alias("k"))
    assert skew.hot_keys(rows, ["k"], 1).count() == 0


def test_small_right_side_is_joined_plainly(spark, sides):
    left, right = sides
    joined = skew.join_spread(left, right, ["k", "k2"], "inner", spread_by="id")
    assert "_salt" not in joined._jdf.queryExecution().toString()
    assert skew.will_broadcast(right)
