"""Clusters of mutually similar records: vectors by cosine, member sets by their shared part.

Density clustering over cells: every record is put into the cells near it, with an overlapping margin, so
that records alike meet in some cell; each cell is clustered on its own; the local clusters
are merged through the core points they share. With a density of one neighbour, each record
that has a like one is a core point, and the result is the transitive closure of being alike.

Vectors: cells are those of a centroid index over reduced (principal) coordinates, and the margin is a number of
nearest cells and a ratio of distances; within a cell vectors are compared in full. Sets: cells are the rarest members of a set, as many
as guarantee that two sets with enough shared members have one in common (prefix filter), so no
pair is lost. Equal vectors and equal sets are one record until the end.

Clusters are described by their size and medoids: the members with the largest mean cosine to their cluster
(by the cluster's vector sum, without comparing pairs) or, for sets, the mean frequency of their members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlode.llm.components import connected_components
from graphlode.llm.vectors import BLOCK_ROWS, SPLIT_ROWS, Reach, cells, distinct_vectors, fit, prepare, unpacked
from graphlode.plans.session import stage


#: Cells that a vector is in: its nearest eight, and all that are hardly farther than the nearest one.
OVERLAP = Reach(ratio=1.04, least=8, every=True)


def local_clusters(n: int, alike, step: int = 512) -> np.ndarray:
    """Label of each of n records: the least index among those linked to it. alike(rows, columns) gives a boolean block."""
    label = np.arange(n)
    active = np.arange(n)
    first = True
    while len(active) > 1:
        before = label.copy()
        near = np.zeros(n, bool)
        for a in range(0, len(active), step):
            rows = active[a : a + step]
            cols = active[a:]  # blocks on and above the diagonal
            block = alike(rows, cols)
            block[np.arange(len(rows)), np.arange(len(rows))] = False
            if not block.any():
                continue
            i, j = np.nonzero(block)
            i, j = rows[i], cols[j]
            near[i] = near[j] = True
            for _ in range(3):  # settle within the block before going on
                low = np.minimum(label[i], label[j])
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
        if first:
            active, first = np.flatnonzero(near), False  # records like no other stay out of later rounds
        if (label == before).all():
            break
    return label


def _stars(ids: pa.Array, label: np.ndarray) -> pa.Table:
    """(a, b): each record of a local cluster with the cluster's record of least id."""
    rank = pc.rank(ids, sort_keys="ascending", tiebreaker="first").to_numpy().astype(np.int64) - 1
    least = np.full(len(label), len(label))
    np.minimum.at(least, label, rank)
    root = np.argsort(rank)[least[label]] if len(label) else label
    at = np.flatnonzero(root != np.arange(len(label)))
    return pa.table({"a": ids.take(pa.array(at)), "b": ids.take(pa.array(root[at]))})


def cluster_vectors(df: DataFrame, least: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """(members (cluster_key, member_key) with the key itself, points (id, vec) of all valid vectors).

    Two vectors are alike when their cosine is at least the threshold (see vector_links for the parameters).
    """
    edges, copies, points = vector_links(df, **how)
    return merged(edges, copies, least), points


def vector_links(df: DataFrame, threshold: float = 0.8, dim: int = 96, id_col: str = "id", vector_col: str = "embedding", order_col: str | None = "indexed_at", reach: Reach = OVERLAP, split: int = SPLIT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges (a, b) of the local clusters' stars, copies (a, b) of equal vectors, points (id, vec))."""
    points = prepare(df, dim, id_col, vector_col, order_col)
    single, copies = distinct_vectors(points)
    index = fit(single, dim)
    kind = points.schema["id"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, block = unpacked(t.column("vec"), dim), t.column("block").to_numpy()
        across = t.column("part_a")[0].as_py() != t.column("part_b")[0].as_py()

        def alike(rows, cols):
            out = x[rows] @ x[cols].T >= threshold
            if across:
                out &= block[rows][:, None] != block[cols][None, :]
            return out

        ids = t.column("id").combine_chunks()
        return _stars(ids, local_clusters(len(x), alike))

    edges = cells(single, index, reach, split=split).groupBy("cell", "part_a", "part_b").applyInArrow(local, f"a {kind}, b {kind}")
    return edges, copies.select(F.col("id").alias("a"), F.col("same_as").alias("b")), points


def merged(edges: DataFrame, copies: DataFrame, least: int) -> DataFrame:
    """Components of the stars; copies join their representative's cluster or, without one, form one of their own."""
    parts = connected_components(edges)
    # copies hang on their representative: no need to take them through the rounds
    own = copies.join(parts, copies["b"] == parts["node"], "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    every = parts.union(own.select("a", "component")).union(own.select("b", "component")).distinct()
    sizes = every.groupBy("component").agg(F.min("node").alias("cluster_key"), F.count("*").alias("size")).where(F.col("size") >= least)
    return every.join(sizes, "component").select("cluster_key", F.col("node").alias("member_key"))


def set_cells(df: DataFrame, share: float, id_col: str, members_col: str) -> tuple[DataFrame, DataFrame]:
    """(cells (cell, id, size, members), copies (id, same_as)) of sets; members are the positions in the order of rarity."""
    sets = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(members_col))).alias("members")).where(F.size("members") > 0).distinct()
    keyed = stage(sets.withColumn("key", F.unhex(F.md5(F.to_json("members")))))
    many = keyed.groupBy("key").agg(F.min("id").alias("same_as"), F.count("*").alias("n")).where("n > 1").select("key", "same_as")
    copies = stage(keyed.select("id", "key").join(many, "key").where("id <> same_as").select("id", "same_as"))
    single = keyed.join(copies.select("id"), "id", "left_anti").select("id", "members")
    member = single.select("id", F.size("members").alias("size"), F.explode("members").alias("member"))
    seen = member.groupBy("member").agg(F.count("*").alias("seen"))
    code = F.struct("seen", F.xxhash64("member").alias("code"))
    ordered = member.join(seen, "member").groupBy("id", "size").agg(F.transform(F.array_sort(F.collect_list(code)), lambda c: c["code"]).alias("codes"))
    # two sets alike share at least ceil(share * size) members, so one of the first size - that + 1 in any common order
    prefix = F.slice("codes", 1, (F.col("size") - F.ceil(F.lit(share) * F.col("size")) + 1).cast("int"))
    return ordered.select("id", "size", "codes", F.explode(prefix).alias("cell")), copies


def cluster_sets(df: DataFrame, share: float = 0.5, least: int = 3, id_col: str = "id", members_col: str = "members") -> DataFrame:
    """(cluster_key, member_key) with the key itself: sets linked by sharing at least ``share`` of both sets' members.

    Null and empty sets take no part; repeated and null members count once or not at all; repeated rows are one.
    A row id with several different sets stands for each of them.
    """
    return merged(*set_links(df, share, id_col, members_col), least)


def set_links(df: DataFrame, share: float = 0.5, id_col: str = "id", members_col: str = "members") -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) of the local clusters' stars, copies (a, b) of equal sets)."""
    dealt, copies = set_cells(df, share, id_col, members_col)
    dealt = stage(dealt)
    kind = dealt.schema["id"].dataType.simpleString()
    n = dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # a cell of over BLOCK_ROWS sets is cut into blocks, and each pair of blocks is a task
    dealt = dealt.join(n, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int"))
    block = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("part_a"), F.greatest("block", "other").alias("part_b"), "block", "id", "codes")
    # cells are small and many, so a task takes its sorted cells as a stream instead of one call each
    sorted_cells = dealt.repartition("cell", "part_a", "part_b").sortWithinPartitions("cell", "part_a", "part_b")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            key = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            same = (key == key[-1]).all(1)
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from several(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from several(pa.Table.from_batches(held))

    def several(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        key = np.stack([t.column(k).to_numpy() for k in range(3)], 1)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
        ids, codes, block = t.column("id").combine_chunks(), t.column("codes").to_pylist(), t.column("block").to_numpy()
        a, b = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)]):
            label = _set_labels(codes[s:e], share, block[s:e] if key[s, 1] != key[s, 2] else None)
            at = np.flatnonzero(label != np.arange(e - s))
            a.append(at + s)
            b.append(label[at] + s)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])

    edges = sorted_cells.mapInArrow(local, f"a {kind}, b {kind}")
    return edges, copies.select(F.col("id").alias("a"), F.col("same_as").alias("b"))


def _set_labels(sets: list[list[int]], share: float, block: np.ndarray | None) -> np.ndarray:
    n = len(sets)
    if n == 2:
        if block is not None and block[0] == block[1]:
            return np.arange(2)
        x, y = set(sets[0]), set(sets[1])
        both = len(x & y)
        return np.array([0, 0 if both >= share * (len(x) + len(y) - both) else 1])
    size = np.array([len(s) for s in sets])
    _, code = np.unique(np.concatenate([np.array(s, np.int64) for s in sets]), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    keep = np.bincount(code)[code] > 1  # members of one set only are never shared
    _, code = np.unique(code[keep], return_inverse=True)
    owner = owner[keep]
    width = int(code.max()) + 1 if len(code) else 1

    def dense(rows: np.ndarray, a: int, z: int) -> np.ndarray:
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        take = (place[owner] >= 0) & (code >= a) & (code < z)
        out = np.zeros((len(rows), z - a), np.float32)
        out[place[owner[take]], code[take] - a] = 1
        return out

    def alike(rows, cols):
        both = np.zeros((len(rows), len(cols)), np.float32)
        for a in range(0, width, 2048):
            z = min(width, a + 2048)
            both += dense(rows, a, z) @ dense(cols, a, z).T
        out = both >= share * (size[rows][:, None] + size[cols][None, :] - both) - 1e-6
        if block is not None:
            out &= block[rows][:, None] != block[cols][None, :]
        return out

    return local_clusters(n, alike)


def describe_vectors(members: DataFrame, points: DataFrame, dim: int, typical: int = 3) -> DataFrame:
    """(cluster_key, size, cohesion, medoids): the members most similar to their cluster, by the cluster's vector sum.

    The mean cosine of x to the n - 1 others is (x . sum - 1) / (n - 1), so one sum a cluster (partially aggregated in
    Arrow batches, so a large cluster is no one task's) gives the medoids exactly; means that agree to six places are equal.
    """
    kind = members.schema["cluster_key"].dataType.simpleString()
    rows = stage(members.join(points, members["member_key"] == points["id"]).select("cluster_key", "member_key", "vec"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).dictionary_encode()
            code, x = key.indices.to_numpy(), unpacked(b.column(1), dim).astype(np.float64)
            order = np.argsort(code, kind="stable")
            present, start = np.unique(code[order], return_index=True)
            total = np.add.reduceat(x[order], start, axis=0)
            n = np.diff(np.append(start, len(code)))
            yield pa.RecordBatch.from_arrays([key.dictionary.take(pa.array(present)), pa.array(n.astype(np.int64)), pa.array(list(total), pa.list_(pa.float64()))], ["cluster_key", "n", "total"])

    parts = rows.select("cluster_key", "vec").mapInArrow(partial, f"cluster_key {kind}, n bigint, total array<double>")
    sums = parts.groupBy("cluster_key").agg(F.sum("n").alias("size"), F.array(*[F.sum(F.element_at("total", i + 1)) for i in range(dim)]).alias("total"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, total = unpacked(b.column(3), dim).astype(np.float64), np.array(b.column(4).to_pylist()).reshape(-1, dim)
            n = b.column(2).to_numpy()
            mean = ((x * total).sum(1) - 1) / np.maximum(n - 1, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.round(mean, 6))], ["cluster_key", "member_key", "size", "mean"])

    scored = rows.join(sums, "cluster_key").select("cluster_key", "member_key", "size", "vec", "total").mapInArrow(score, f"cluster_key {kind}, member_key {kind}, size bigint, mean double")
    return _typical(scored, typical)


def describe_sets(members: DataFrame, df: DataFrame, id_col: str = "id", members_col: str = "members", typical: int = 3) -> DataFrame:
    """(cluster_key, size, cohesion, medoids): the sets whose members are the most frequent in their cluster."""
    sets = df.select(F.col(id_col).alias("member_key"), F.array_distinct(F.array_compact(members_col)).alias("members")).dropDuplicates(["member_key"])
    rows = members.join(sets, "member_key").select("cluster_key", "member_key", F.explode("members").alias("m"))
    often = rows.groupBy("cluster_key", "m").agg(F.count("*").alias("seen"))
    size = members.groupBy("cluster_key").agg(F.count("*").alias("size"))
    scored = rows.join(often, ["cluster_key", "m"]).groupBy("cluster_key", "member_key").agg(F.avg("seen").alias("mean")).join(size, "cluster_key")
    return _typical(scored.withColumn("mean", F.round(F.col("mean") / F.col("size"), 9)), typical)


def _typical(scored: DataFrame, typical: int) -> DataFrame:
    """The most typical members of each cluster; a large cluster is ranked in salted parts first."""
    best = scored.withColumn("salt", F.pmod(F.xxhash64("member_key"), F.lit(64)))
    for key in (("cluster_key", "salt"), ("cluster_key",)):
        best = best.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("mean"), "member_key"))).where(F.col("place") <= typical)
    medoids = best.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "member_key"))), lambda s: s["member_key"]).alias("medoids"))
    whole = scored.groupBy("cluster_key").agg(F.first("size").alias("size"), F.round(F.avg("mean"), 6).alias("cohesion"))
    return whole.join(medoids, "cluster_key").select("cluster_key", "size", "cohesion", "medoids")
