import random

from pyspark.sql import functions as F

from graphloom.llm.common import SALTS, fresh_name, running, with_group


def test_running(spark):
    r = random.Random(1)
    rows = [[r.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 2, 127, 128, 129, 256, 1000)]
    df = spark.createDataFrame([(x,) for x in rows], "v array<int>")
    got = df.select("v", running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("sums"), running(F.col("v"), F.lit(0), lambda a, b: F.greatest(a, b)).alias("most")).collect()
    for row in got:
        assert row.sums == [sum(row.v[:i]) for i in range(len(row.v))]
        assert row.most == [max([0, *row.v[:i]]) for i in range(len(row.v))]


def test_groups_are_dealt_over_salts(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)], "i long, k string")
    got = with_group(rows, ["k"], ["i"], low=(F.min, "i"), high=(F.max, "i"))
    assert got.columns == ["k", "i", "low", "high"]
    for r in got.collect():
        assert (r.low, r.high) == ((1, 2999) if r.k == "hot" else (r.i, r.i))
    assert got.count() == 3000 and SALTS > 1


def test_fresh_name(spark):
    assert fresh_name(spark.createDataFrame([(1, 2)], "Hits int, _hits int"), "hits") == "__hits"
