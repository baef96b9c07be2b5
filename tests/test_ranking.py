"""Global positions under a hot key equal a plain sort's positions."""

import random

from panelkit.operators.ranking import with_global_index


def test_global_index_with_a_hot_key(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.9 else f"k{rnd.randint(0, 9)}", rnd.randint(0, 50), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k STRING, v INT, id INT").repartition(7)
    got = {r.id: (r.idx, r.gidx) for r in
           with_global_index(with_global_index(df, ["k", "v", "id"], "idx"), ["k", "v", "id"], "gidx",
                             group_cols=["k"]).collect()}
    order = sorted(rows, key=lambda r: (r[0], r[1], r[2]))
    first = {}
    for pos, (k, _, i) in enumerate(order):
        first.setdefault(k, pos)
        assert got[i] == (pos, pos - first[k])


def test_global_index_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k STRING, v INT")
    got = {(r.k, r.v): r.gidx for r in with_global_index(df, ["k", "v"], "gidx", group_cols=["k"]).collect()}
    assert got == {(None, 1): 0, (None, 3): 1, ("a", 2): 0}


def test_hash_sample_takes_any_key(spark):
    from pyspark.sql import functions as F

    from panelkit.operators.sampling import hash_sample
    df = spark.range(20_000).select(F.concat(F.lit("140US"), F.col("id")).alias("t"), F.xxhash64("id").alias("h"), F.col("id").cast("int").alias("i"))
    for key in ("t", "h", "i", ["t", "h"]):
        n = hash_sample(df, key, 0.05).count()
        assert 700 < n < 1300 and n == hash_sample(df.repartition(3), key, 0.05).count()
