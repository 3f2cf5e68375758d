"""Vector functions as higher-order functions in the JVM, exact top-k and the vector table's operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; null for vectors of different length."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def euclid(a: Column, b: Column) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d))


def normalized(a: Column) -> Column:
    """A zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def usable(a: Column, dim: int) -> Column:
    return a.isNotNull() & (F.size(a) == dim) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & F.exists(a, lambda x: x != 0)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, min_score: float | None = None, id_col: str = "id", vector_col: str = "embedding", **equals) -> DataFrame:
    """The k rows most similar to one query vector: metadata filters first, then one pass that keeps k rows a task."""
    for name, value in equals.items():
        vectors = vectors.where(F.col(name) == F.lit(value))
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(usable(F.col(vector_col), len(query))).withColumn("score", cosine(F.col(vector_col), q))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def low_confidence(hits: DataFrame, least: float = 0.35) -> DataFrame:
    """(best, low): the best score and whether it is too low to be trusted; no hits are low."""
    return hits.agg(F.max("score").alias("best")).withColumn("low", F.coalesce(F.col("best") < least, F.lit(True)))


def mean_vector(df: DataFrame, key: list[str], vector_col: str) -> DataFrame:
    """(*key, n, mean): element-wise mean; positions are aggregated in parallel, so no key is gathered."""
    at = df.select(*key, F.posexplode(vector_col).alias("_at", "_x")).groupBy(*key, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    return at.groupBy(*key).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_at", "_m"))), lambda s: s["_m"]).alias("mean"))


# -- the vector table ------------------------------------------------------------------------------------------
def upsert_vectors(old: DataFrame, batch: DataFrame) -> DataFrame:
    """New rows replace old ones with their id."""
    return old.join(batch.select("id").distinct(), "id", "left_anti").select(*old.columns).unionByName(batch.dropDuplicates(["id"]).select(*old.columns))


def fetch(vectors: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else vectors.where(F.col("id").isin(*ids))


def delete(vectors: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti") if isinstance(ids, DataFrame) else vectors.where(~F.col("id").isin(*ids))


def delete_project(vectors: DataFrame, project: str) -> DataFrame:
    return vectors.where(F.col("project") != project)


def split_by_cache(texts: DataFrame, cache: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their cached vector, distinct (sha256, text) still to embed), by the text's SHA-256."""
    keyed = texts.withColumn("sha256", F.sha2(text_col, 256))
    hits = keyed.join(cache.select("sha256", "vec"), "sha256")
    misses = keyed.join(cache.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.first(text_col).alias(text_col))
    return hits, misses


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic offline embedding: signed counts of hashed words, scaled to length 1; a text without words is zero.

    Any vectorised function of a batch of texts can stand in its place (an embedding service, say).
    """
    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()) if t else ():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(norms == 0, 1, norms)).astype(np.float32)))

    return embed(text)
