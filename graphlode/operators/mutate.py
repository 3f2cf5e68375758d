"""Upserts, deletes, deduplication and incremental change detection on plain Parquet tables.

Without a table format that updates in place, every mutation is an expression of the old table and a batch; writing
the result replaces the partitions it touches (see sources.store).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.model import EDGE_KEY, NODE_KEY


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows with one key the last by ``order``: a partial aggregate, so a repeated key is combined early."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, "_last.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, key: tuple[str, ...], set_keys: str | None = None) -> DataFrame:
    """Merge properties: a row of ``new`` creates its key or updates it; what it does not set stays.

    Without ``set_keys`` a null in new means not set. With it, the array column of that name lists the properties that
    are set, so that null removes a value. new must have one row a key (see last_wins).
    """
    props = [c for c in old.columns if c not in key]
    n = new.select(*key, F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in props], *([F.col(set_keys).alias("_set")] if set_keys else [])).alias("_n"))
    o = old.select(*key, F.struct(*props).alias("_o"))
    joined = o.join(n, list(key), "full_outer")

    def merged(c: str) -> Column:
        if set_keys:
            return F.when(F.col("_n").isNotNull() & F.array_contains(F.col("_n._set"), c), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}"))
        return F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}"))

    return joined.select(*key, *[merged(c).alias(c) for c in props]).select(*old.columns)


def upsert_nodes(old: DataFrame, batch: DataFrame, set_keys: str | None = None) -> DataFrame:
    return upsert(old, batch, NODE_KEY, set_keys)


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes; the others vanish."""
    ends = nodes.select("project", "label", "key").distinct()
    s = ends.select("project", F.col("label").alias("src_label"), F.col("key").alias("src_key"))
    t = ends.select("project", F.col("label").alias("dst_label"), F.col("key").alias("dst_key"))
    return edges.join(s, ["project", "src_label", "src_key"], "left_semi").join(t, ["project", "dst_label", "dst_key"], "left_semi")


def upsert_edges(old: DataFrame, batch: DataFrame, nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    new = with_endpoints(batch, nodes)
    new = last_wins(new, list(EDGE_KEY), order or [c for c in new.columns if c not in EDGE_KEY])
    return upsert(old, new, EDGE_KEY)


def append_nodes(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Create without merging: a key that is there already gets another row (see violations)."""
    return old.unionByName(batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]))


def delete_relations(edges: DataFrame, *types: str) -> DataFrame:
    """All relations of the types go, their nodes stay."""
    return edges.where(~F.col("rel_type").isin(*types)) if types else edges


def append_edges(old: DataFrame, batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Create without merging: parallel edges stay."""
    return old.unionByName(with_endpoints(batch, nodes).select(*old.columns))


def update(df: DataFrame, where: Column, key: tuple[str, ...] = NODE_KEY, **values) -> DataFrame:
    """Set properties of the rows that match; key columns may not change, and no values change nothing."""
    if set(values) & set(key):
        raise ValueError("a key cannot be updated")
    for c, v in values.items():
        df = df.withColumn(c, F.when(where, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return df


def detach_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``gone`` (project, label, key) and every edge at one of them."""
    g = gone.select("project", "label", "key").distinct()
    kept = nodes.join(g, list(NODE_KEY), "left_anti")
    for side in ("src", "dst"):
        edges = edges.join(g.select("project", F.col("label").alias(f"{side}_label"), F.col("key").alias(f"{side}_key")), ["project", f"{side}_label", f"{side}_key"], "left_anti")
    return kept, edges


def delete_project(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Everything of a project goes: its partitions are dropped."""
    return nodes.where(F.col("project") != project), edges.where(F.col("project") != project)


def violations(nodes: DataFrame, keys: tuple[str, ...] = NODE_KEY) -> DataFrame:
    """(*keys, n): keys held by more than one row."""
    return nodes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def changes(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(*key, change): new, changed, unchanged or deleted, by a full outer join on the key."""
    o, n = old.select(*key, F.col(digest).alias("_o")), new.select(*key, F.col(digest).alias("_n"))
    kind = F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("changed")
    return o.join(n, key, "full_outer").select(*key, kind.alias("change"))


def prune(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(project, label, key) of nodes whose file is no longer there; nodes without a file stay."""
    f = files.select("project", F.col("path").alias("file_path")).distinct()
    return nodes.where("file_path is not null").join(f, ["project", "file_path"], "left_anti").select("project", "label", "key").distinct()


def token_budget(df: DataFrame, order: list[str], text: Column, budget: int, partition: list[str] | None = None) -> DataFrame:
    """The first rows whose estimated tokens together stay within the budget; the first that exceeds it ends the result."""
    window = Window.partitionBy(*(partition or [])).orderBy(*order)
    used = F.sum(F.ceil(F.length(text) / 4)).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_used", used).where(F.col("_used") <= budget).drop("_used")
