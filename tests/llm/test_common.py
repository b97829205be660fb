from pyspark.sql import functions as F

from tillmark.llm.common import likely, lower_ascii, packed, salted_join, stored, unpacked


def test_a_hot_key_is_spread_and_joins_as_ever(spark):
    rows = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 1500 as string)) k")
    groups = stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "groups")
    joined = salted_join(rows, groups, ["k"], "n", ["id"])
    assert sorted(joined.columns) == ["id", "k", "top"]
    assert sorted(map(tuple, joined.select("id", "k", "top").collect())) == sorted(
        map(tuple, rows.join(groups.drop("n"), "k").select("id", "k", "top").collect())
    )
    some = stored(groups.where("k <> 'hot'"), "some")
    left = salted_join(rows, some, ["k"], "n", ["id"], "left")
    assert left.count() == 6000 and left.where("top is null").count() == 2000
    assert salted_join(rows, stored(groups.limit(0), "none"), ["k"], "n", ["id"], "left").count() == 6000


def test_no_row_of_a_key_is_left_out(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) k")
    keys = rows.where("id % 50 = 0")
    found = likely(rows, F.xxhash64("k"), keys, F.xxhash64("k"))
    assert found.columns == rows.columns
    assert found.join(keys, "id", "left_semi").count() == keys.count()
    assert found.count() < 1000  # and few others come along
    assert likely(rows, F.xxhash64("k"), keys.limit(0), F.xxhash64("k")).count() == 0


def test_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "x", "y")], "`_row` long, `a.b` string, key string")
    back = unpacked(packed(df, key=F.lit(7)), key=F.lit("z"))
    assert back.columns == df.columns and tuple(back.first()) == (1, "x", "z")


def test_only_ascii_letters_change(spark):
    df = spark.createDataFrame([("AbZ",), ("ÄÉİ AZ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(lower_ascii(F.col("t"))).collect()] == ["abz", "ÄÉİ az", "", None]
