"""Per-key results where a few keys hold most rows.

Counts, means and extremes are mergeable, so they are combined before any shuffle and a hot key costs one partial
row per task. Exact quantiles of hot keys come from distributed selection: each round every task counts the hot
keys' values in buckets between the bounds known so far, the counts are merged, and the bucket that holds the wanted
rank gives the next, narrower bounds, until its least and greatest value are the same. No value of a hot key ever
leaves the task that reads it. A key is hot if it has at least ``hot_share`` of all rows or ``hot_rows`` rows, so no
task ever sorts more than hot_rows values of a key. The bounds of hot keys are broadcast while there are few of them, and joined otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.plans.session import cut

#: Buckets a round: the partial counts of a task are at most hot keys * quantiles * BUCKETS rows.
BUCKETS = 1024
#: Bounds of hot keys that are broadcast at most, under 10 MB; more meet the rows in a join.
BROADCAST_BOUNDS = 50_000


def normal_name(name: Column) -> Column:
    """One spelling of a qualified name: no blanks around it, ``/`` for a backslash, no leading ``./``."""
    return F.regexp_replace(F.translate(F.regexp_replace(name, r"^\s+|\s+$", ""), "\\", "/"), r"^\./", "")


def once(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """(id_col, *columns): one row for each id, the least of its rows; rows without id stay as they are."""
    value = F.struct(*columns)
    known = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(value).alias("_value")).select(id_col, "_value.*")
    return known.unionByName(df.where(F.col(id_col).isNull()).select(id_col, *columns))


def per_key(df: DataFrame, keys: list[str], value: str, valid: Column) -> DataFrame:
    """(*keys, n_rows, n_valid, mean): rows and valid values of each key; mean is null without a valid value.

    Keys with a null part are no keys. Sums are exact decimals, so the mean does not depend on the order of rows.
    """
    good = F.when(valid, F.col(value))
    known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    total = F.sum(good.cast("decimal(20,12)"))
    grouped = known.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(good).alias("n_valid"), total.alias("_total"))
    return grouped.select(*keys, "n_rows", "n_valid", F.round(F.col("_total").cast("double") / F.col("n_valid"), 6).alias("mean"))


def heavy_keys(df: DataFrame, keys: list[str], value: str, valid: Column, share: float) -> DataFrame:
    """The rows of ``per_key`` of keys that hold at least ``share`` of all rows, those without a key included."""
    total = df.agg(F.count("*")).scalar()
    return per_key(df, keys, value, valid).where(F.col("n_rows") >= F.lit(share) * total)


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: tuple[float, ...], hot_share: float = 0.001, hot_rows: int = 1_000_000, max_rounds: int = 80) -> DataFrame:
    """(*keys, quantile, result): the exact discrete quantiles of each key's values.

    The result for q over n values is the value of rank ceil(q * n), at least 1. Null and NaN values are left out, keys
    without a value give no row.
    """
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counts = cut(counts)
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("_n") >= max(2, min(hot_share * total, hot_rows)))
    quantile = F.explode(F.array(*[F.lit(float(q)) for q in wanted])).alias("quantile")
    rank = F.greatest(F.ceil(F.col("quantile") * F.col("_n")), F.lit(1)).cast("long")
    state = cut(hot.select(*keys, "_n", "_lo", "_hi", quantile).select(*keys, "quantile", rank.alias("_rank"), "_lo", "_hi"))
    out = state.where("_lo = _hi").select(*keys, "quantile", F.col("_lo").alias("result"))
    state = state.where("_lo < _hi")
    for _ in range(max_rounds):
        open_ = state.count()
        if not open_:
            break
        at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS), F.lit(BUCKETS - 1))
        inside = rows.join(F.broadcast(state) if open_ <= BROADCAST_BOUNDS else state, keys).where("_v between _lo and _hi")
        filled = inside.groupBy(*keys, "quantile", "_rank", at.alias("_at")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        order = Window.partitionBy(*keys, "quantile").orderBy("_at")
        before = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = cut(filled.withColumn("_before", before).where((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))))
        found = found.select(*keys, "quantile", (F.col("_rank") - F.col("_before")).alias("_rank"), "_lo", "_hi")
        out = out.unionByName(found.where("_lo = _hi").select(*keys, "quantile", F.col("_lo").alias("result")))
        state = found.where("_lo < _hi")
    else:
        raise RuntimeError("ranks did not resolve")
    cold = rows.join(F.broadcast(hot.select(*keys)) if hot.count() <= BROADCAST_BOUNDS else hot.select(*keys), keys, "left_anti")
    ordered = cold.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    ranks = ordered.select(*keys, "_v", "_place", "_n", quantile).where(F.col("_place") == rank)
    return out.unionByName(ranks.select(*keys, "quantile", F.col("_v").alias("result")))
