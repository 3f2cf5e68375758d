import math
import random

from pyspark.sql import functions as F

from graphlode.operators import hotkeys as H


def test_quantiles_match_brute_force(spark):
    r = random.Random(3)
    rows = [("hot", r.choice([r.random(), r.randrange(5) / 4, r.random() * 1e-12])) for _ in range(4000)] + [(f"k{r.randrange(300)}", r.random()) for _ in range(2000)] + [("one", 0.5), (None, 0.1), ("none", None), ("nan", math.nan), ("same", 0.25)] + [("same", 0.25)] * 40
    df = spark.createDataFrame(rows, "k string, v double")
    wanted = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {(x["k"], x["quantile"]): x["result"] for x in H.quantiles(df, ["k"], "v", wanted, hot_share=0.01).collect()}
    by = {}
    for k, v in rows:
        if k is not None and v is not None and not math.isnan(v):
            by.setdefault(k, []).append(v)
    assert got == {(k, q): sorted(v)[max(1, math.ceil(q * len(v))) - 1] for k, v in by.items() for q in wanted}


def test_per_key_and_heavy_keys(spark):
    rows = [(1, "a", 0.5), (1, "a", 0.5), (2, "a", math.nan), (3, "b", 2.0), (4, None, 0.1), (5, "a", None), (None, "c", 0.3)]
    df = spark.createDataFrame(rows, "id int, k string, v double").withColumn("_total", F.lit(1))
    one = H.once(df, "id", "k", "v")
    assert one.count() == 6
    valid = F.col("v").between(0.0, 1.0)
    got = {r["k"]: (r["n_rows"], r["n_valid"], r["mean"]) for r in H.per_key(one, ["k"], "v", valid).collect()}
    assert got == {"a": (3, 1, 0.5), "b": (1, 0, None), "c": (1, 1, 0.3)}
    assert [r["k"] for r in H.heavy_keys(one, ["k"], "v", valid, 0.5).collect()] == ["a"]
    assert H.heavy_keys(one.limit(0), ["k"], "v", valid, 0.5).count() == 0
    assert H.quantiles(one.limit(0), ["k"], "v", (0.5,)).count() == 0


def test_one_spelling(spark):
    names = [" ./a\\b.py:f ", "a/b.py:f", "\ta/b.py:f", ".\\a\\b.py:f", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(H.normal_name(F.col("n")).alias("n"))
    assert {r["n"] for r in df.collect()} == {"a/b.py:f", None}
