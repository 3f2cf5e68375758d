"""Nearest neighbours and cells of vectors: balanced posting lists around centroids.

The index (centroids in reduced coordinates, and a neighbour graph over them) is fitted on a bounded
sample and is small; every vector is then put into the posting lists of its nearest centroids, and
boundary vectors also into those lists whose centroid is hardly farther away (distance ratio). A query
vector searches the centroid graph from a few entry nodes and reads the lists that distance-ratio pruning
leaves, and a few more at least. Vectors are compared exactly, in full dimension, within a list.

A cell that holds many rows gets centroids of its own, fitted on a sample of its rows by one task a cell, so lists
stay small while the data grow. Its rows meet these centroids in a join: what is broadcast is the first level only.

Embeddings that are null, of another length, all zero or not finite take no part. Of several rows under
one id the one indexed last holds. Equal vectors are one entry of the index with all their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlode.plans.session import stage

#: Bound of the sample on which an index is fitted; it is the only part of the data the driver sees.
FIT_ROWS = 32_768
#: Vectors a posting list has on average, until FIT_ROWS // 8 centroids are reached.
LIST_ROWS = 256
#: Rows of a cell that one task compares; a larger cell is cut into blocks and each pair of blocks is a task.
BLOCK_ROWS = 4_096
#: Rows of a cell from which it gets centroids of its own, fitted on at most about CELL_FIT_ROWS of them.
SPLIT_ROWS, CELL_FIT_ROWS = 16_384, 16_384
#: Numbers of the lists within a cell: list = cell * SPAN + place.
SPAN = 1 << 20


def latest(df: DataFrame, id_col: str = "id", order_col: str = "indexed_at", keep: tuple[str, ...] = ("embedding",)) -> DataFrame:
    """(id_col, *keep) of the row with the latest order_col for each id; a null order comes first.

    A partial aggregate, so an id that a third of all rows carry is combined before the shuffle.
    """
    value = F.struct(*keep)
    order = F.struct(F.coalesce(F.col(order_col).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.xxhash64(*keep))
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by(value, order).alias("value")).select(id_col, "value.*")


def unit_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the valid vectors, those vectors with length 1 as float32)."""
    n = len(column)
    length = np.diff(column.offsets.to_numpy())
    ok = (length == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ok)
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[column.offsets.to_numpy()[:n][at][:, None] + np.arange(dim)]
    top = np.abs(x).max(1)
    fine = np.isfinite(top) & (top > 0)
    x, at = x[fine], at[fine]
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return at, x.astype(np.float32)


def prepare(df: DataFrame, dim: int, id_col: str = "id", vector_col: str = "embedding", order_col: str | None = "indexed_at") -> DataFrame:
    """(id, vec, n): the valid vectors, normalised, packed as little-endian float32, with a short unique number; staged."""
    rows = latest(df, id_col, order_col, (vector_col,)) if order_col else df.select(id_col, vector_col)
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = unit_vectors(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), packed(x)], ["id", "vec"])

    return stage(rows.select(id_col, F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(run, f"id {kind}, vec binary").withColumn("n", F.monotonically_increasing_id()))


def packed(x: np.ndarray) -> pa.Array:
    size = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.frombuffer(p.buffers()[2], np.float32, len(p) * dim, int(np.frombuffer(p.buffers()[1], np.int32, 1, p.offset * 4)[0])).reshape(-1, dim) for p in parts if len(p)]
    return np.concatenate(out) if out else np.zeros((0, dim), np.float32)


def distinct_vectors(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points with one id for each different vector, (id, same_as) of all ids whose vector has a smaller id)."""
    keyed = points.select("id", F.unhex(F.md5("vec")).alias("key"))
    many = keyed.groupBy("key").agg(F.min("id").alias("same_as"), F.count("*").alias("n")).where("n > 1").select("key", "same_as")
    copies = stage(keyed.join(many, "key").where("id <> same_as").select("id", "same_as"))
    return points.join(copies.select("id"), "id", "left_anti"), copies


class CellIndex:
    """Centroids in reduced coordinates and the graph over them."""

    def __init__(self, sample: np.ndarray, rows: int, reduced: int = 72, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, dim = sample.shape
        self.dim = dim
        if n == 0:
            self.base, self.centroids = np.zeros((dim, min(dim, reduced)), np.float32), np.zeros((1, min(dim, reduced)), np.float32)
        else:
            _, vectors = np.linalg.eigh((sample.T @ sample).astype(np.float64) / n)
            self.base = np.ascontiguousarray(vectors[:, ::-1][:, : min(dim, reduced)], np.float32)
            self.centroids = centroids_of(self.reduce(sample), rows, rng)
        c = self.centroids
        k = len(c)
        near = min(k, 24)
        self.graph = np.empty((k, near), np.int32)
        for a in range(0, k, 1024):
            s = c[a : a + 1024] @ c.T
            self.graph[a : a + 1024] = np.argpartition(-s, near - 1, axis=1)[:, :near]
        # a few random long edges keep the graph connected
        self.graph = np.concatenate([self.graph, rng.integers(0, k, (k, 4)).astype(np.int32)], 1)
        self.entries = np.sort(rng.permutation(k)[: max(1, int(10 * np.sqrt(k)))]).astype(np.int32)

    def reduce(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.base
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)

    def search(self, x: np.ndarray, width: int = 24, settled: int = 16, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of about the ``width`` nearest centroids to reduced vectors, nearest first.

        Best-first search in the graph: the ``expand`` nearest centroids not yet expanded give their neighbours, until the ``settled`` nearest
        of all that were met are expanded.
        """
        k, c = len(self.centroids), self.centroids
        width = min(width, k)
        settled = min(settled, width)
        first = x @ c[self.entries].T
        m = min(width, len(self.entries))
        top = np.argpartition(-first, m - 1, axis=1)[:, :m]
        beam, score = np.full((len(x), width), -1, np.int32), np.full((len(x), width), -2, np.float32)
        beam[:, :m], score[:, :m] = self.entries[top], np.take_along_axis(first, top, 1)
        order = np.argsort(-score, axis=1)
        beam, score = np.take_along_axis(beam, order, 1), np.take_along_axis(score, order, 1)
        seen = beam < 0  # expanded already
        active = np.arange(len(x))
        while len(active):
            b, s, done = beam[active], score[active], seen[active]
            front = np.argsort(done, axis=1, kind="stable")[:, :expand]  # the nearest ones not expanded
            np.put_along_axis(done, front, True, 1)
            nxt = self.graph[np.maximum(np.take_along_axis(b, front, 1), 0)].reshape(len(active), -1)
            got = np.einsum("ijk,ik->ij", c[nxt], x[active], optimize=False)
            b, s = np.concatenate([b, nxt], 1), np.concatenate([s, got], 1)
            done = np.concatenate([done, np.zeros(nxt.shape, bool)], 1)
            order = np.argsort(b * 2 + ~done, axis=1)  # an expanded entry comes before its repetitions
            b, s, done = (np.take_along_axis(v, order, 1) for v in (b, s, done))
            s[:, 1:][b[:, 1:] == b[:, :-1]] = -2
            top = np.argpartition(-s, width - 1, axis=1)[:, :width]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
            b, s, done = (np.take_along_axis(v, top, 1) for v in (b, s, done))
            beam[active], score[active], seen[active] = b, s, done | (s <= -2)
            active = active[~seen[active][:, :settled].all(1)]
        return beam, np.where(score > -2, np.maximum(0, 2 - 2 * score), 1e9)

    def lists(self, x: np.ndarray, reach: Reach) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance, whether the row is stored there) of all lists that the rows of x read.

        Where the beam of the graph search ends within the ratio or before it has enough lists, or for each vector if
        ``reach.every``, all centroids (at most FIT_ROWS // 8, or a few more after halving) are scored, so the beam is no limit.
        """
        out = []
        for a in range(0, len(x), 1024):
            y = self.reduce(x[a : a + 1024])
            full = np.arange(len(y))
            if not reach.every:
                best, d2 = self.search(y)
                d = np.sqrt(d2)
                short = (d[:, -1] <= reach.ratio * np.maximum(d[:, 0], 1e-3)) | (d[:, min(reach.least, best.shape[1]) - 1] > 100)
                short &= best.shape[1] < len(self.centroids)
                short |= (d2[:, -1] > 100) & (best.shape[1] == len(self.centroids))
                rest = np.flatnonzero(~short)
                out.append(reach.chosen(a, rest, best[rest], d[rest]))
                full = np.flatnonzero(short)
            if len(full):
                out.append(nearest_lists(y[full], self.centroids, reach, a, full))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (none, none, none.astype(float), none.astype(bool))


@dataclass(frozen=True)
class Reach:
    """Which lists a vector reads and in which of them it is stored: all within a ratio of the least distance, and a least number."""

    ratio: float = 1.04
    least: int = 8
    member_ratio: float | None = None  # stored in all lists it reads, without
    member_least: int = 0
    every: bool = False  # score all centroids instead of walking the graph

    def chosen(self, begin: int, rows: np.ndarray, best: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance, stored) of sorted candidates."""
        place = np.arange(d.shape[1])[None, :]
        low = np.maximum(d[:, :1], 1e-3)
        i, j = np.nonzero(((d <= self.ratio * low) | (place < self.least)) & (d < 100))
        stored = np.ones(len(i), bool) if self.member_ratio is None else (d[i, j] <= self.member_ratio * low[i, 0]) | (j < self.member_least)
        return rows[i] + begin, best[i, j].astype(np.int64), d[i, j], stored


def nearest_lists(y: np.ndarray, c: np.ndarray, reach: Reach, begin: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    d = np.sqrt(np.maximum(0, 2 - 2 * (y @ c.T)))
    # as many of the nearest as any row needs
    m = min(len(c), max(reach.least, int((d <= reach.ratio * np.maximum(d.min(1, keepdims=True), 1e-3)).sum(1).max(initial=1))))
    best = np.argpartition(d, m - 1, axis=1)[:, :m]
    best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
    return reach.chosen(begin, rows, best, np.take_along_axis(d, best, 1))


def centroids_of(x: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means for lists of LIST_ROWS of the ``rows`` that x is a sample of.

    Lists of over twice the mean size are halved unless they are one tight group.
    """
    k = int(max(1, min(rows // LIST_ROWS, max(1, len(x) // 8))))
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(6):
        c = _means(x, _nearest(x, c), c)
    label = _nearest(x, c)
    todo, out = [np.flatnonzero(label == j) for j in range(len(c))], []
    while todo:
        rows_ = todo.pop()
        if not len(rows_):
            continue
        mean = x[rows_].sum(0)
        tight = np.linalg.norm(mean) / len(rows_)
        mean /= max(np.linalg.norm(mean), 1e-9)
        if len(rows_) > 2 * len(x) / k + 8 and tight < 0.8:
            two = x[rows_[rng.permutation(len(rows_))[:2]]].copy()
            for _ in range(4):
                half = _nearest(x[rows_], two)
                two = _means(x[rows_], half, two)
            half = _nearest(x[rows_], two)
            if 0 < half.sum() < len(rows_):
                todo += [rows_[half == 0], rows_[half == 1]]
                continue
        out.append(mean)
    return np.array(out, np.float32)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])


def _means(x: np.ndarray, label: np.ndarray, old: np.ndarray) -> np.ndarray:
    order = np.argsort(label, kind="stable")
    present, start = np.unique(label[order], return_index=True)
    c = old.copy()
    c[present] = np.add.reduceat(x[order], start, axis=0)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def fit(points: DataFrame, dim: int) -> CellIndex:
    """Fit an index on at most about FIT_ROWS of the points, taken by the hash of their id."""
    rows = points.count()
    sample = points.where(_sampled("fit", "id", min(1.0, FIT_ROWS / max(1, rows)))).select("vec").toArrow()
    return CellIndex(unpacked(sample.column("vec"), dim), rows)


def _sampled(seed: str, key: str, share: float | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20)) < (F.lit(share) * (1 << 20)).cast("int") + 1


def cells(points: DataFrame, index: CellIndex, reach: Reach, key: str = "id", split: int = SPLIT_ROWS) -> DataFrame:
    """(cell, part_a, part_b, key, block, member, vec): each vector, named by its unique ``key``, once for each task that compares it.

    A vector reads the lists that ``reach`` says and is stored in some of them. Lists of over BLOCK_ROWS rows are cut into blocks by the hash of
    the id. If a cell has over ``split`` rows, such cells get lists of their own (see two_levels).
    """
    kind = points.schema[key].dataType.simpleString()
    shared = points.sparkSession.sparkContext.broadcast(index)  # at most FIT_ROWS / 8 centroids and their graph: under 10 MB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cell, _, _ = shared.value.lists(unpacked(b.column(0), shared.value.dim), reach)
            which, n = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

    sizes = points.select("vec").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > min(BLOCK_ROWS, split)).collect()
    large = {r["cell"]: r["n"] for r in sizes}  # at most as many as there are centroids
    salted = points.select(key, "vec", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(1 << 30)).alias("salt"))
    if any(n > split for n in large.values()):
        return two_levels(salted, shared, reach, key, {c: n for c, n in large.items() if n > split})
    blocks = {c: -(-n // BLOCK_ROWS) for c, n in large.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "part_a", "part_b", "block", "member", key, "vec"]
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                row, cell, _, member = shared.value.lists(unpacked(part.column(1), shared.value.dim), reach)
                salt = part.column(2).to_numpy(zero_copy_only=False)[row]
                n_blocks = np.array([blocks.get(c, 1) for c in cell.tolist()], np.int64)
                block = np.where(n_blocks > 1, salt % np.maximum(n_blocks, 1), 0)
                copies = np.repeat(np.arange(len(row)), n_blocks)
                other = np.arange(len(copies)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
                mine = block[copies]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cell[copies].astype(np.int64)), pa.array(np.minimum(mine, other).astype(np.int32)), pa.array(np.maximum(mine, other).astype(np.int32)),
                        pa.array(mine.astype(np.int32)), pa.array(member[copies]), part.column(0).take(pa.array(row[copies])), part.column(1).take(pa.array(row[copies])),
                    ], names)

    return salted.mapInArrow(deal, f"cell bigint, part_a int, part_b int, block int, member boolean, {key} {kind}, vec binary")


def two_levels(salted: DataFrame, shared: Broadcast, reach: Reach, key: str, large: dict[int, int]) -> DataFrame:
    """The rows of ``cells`` where the ``large`` cells have lists of their own; a cell beside them is one list.

    The lists of a large cell are fitted by one task on a sample of its rows. Its rows, in blocks, meet them in a join by cell and block
    and name their nearest lists; a vector then keeps the nearest of all lists named in its cells.
    """
    kind = salted.schema[key].dataType.simpleString()
    wanted = np.array(sorted(large), np.int64)
    blocks = {c: -(-n // BLOCK_ROWS) for c, n in large.items()}

    def coarse(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                row, cell, d, _ = shared.value.lists(unpacked(b.column(1), shared.value.dim), reach)
                take = np.isin(cell, wanted) == inside
                row, cell, d = row[take], cell[take], d[take]
                named = b.column(0).take(pa.array(row))
                if not inside:
                    yield pa.RecordBatch.from_arrays([named, pa.array(cell * SPAN), pa.array(d.astype(np.float32))], [key, "list", "d"])
                    continue
                block = b.column(2).to_numpy(zero_copy_only=False)[row] % np.array([blocks[c] for c in cell.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block), named, b.column(1).take(pa.array(row))], ["cell", "block", key, "vec"])

        return run

    def fit_cell(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        c = t.column("cell")[0].as_py()
        x = shared.value.reduce(unpacked(t.column("vec"), shared.value.dim))
        return pa.table({"cell": pa.array([c], pa.int64()), "centroids": pa.array([centroids_of(x, large[c], np.random.default_rng(c)).tobytes()], pa.binary())})

    def name_lists(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        none = pa.schema([(key, rows.schema.field(key).type), ("list", pa.int64()), ("d", pa.float32())]).empty_table()
        if not rows.num_rows or not fitted.num_rows:
            return none
        rows = rows.combine_chunks()
        c = np.frombuffer(fitted.column("centroids")[0].as_py(), np.float32).reshape(-1, shared.value.base.shape[1])
        y = shared.value.reduce(unpacked(rows.column("vec"), shared.value.dim))
        row, place, d, _ = (np.concatenate(v) for v in zip(*(nearest_lists(y[a : a + 1024], c, reach, a, np.arange(len(y[a : a + 1024]))) for a in range(0, len(y), 1024))))
        cell = rows.column("cell")[0].as_py()
        return pa.table([rows.column(key).take(pa.array(row)), pa.array(cell * SPAN + place), pa.array(d.astype(np.float32))], schema=none.schema)

    dealt = salted.mapInArrow(coarse(True), f"cell bigint, block bigint, {key} {kind}, vec binary")
    share = F.create_map(*[F.lit(v) for c, n in large.items() for v in (int(c), min(1.0, CELL_FIT_ROWS / n))])[F.col("cell")]
    fitted = stage(dealt.where(_sampled("cell", key, share)).groupBy("cell").applyInArrow(fit_cell, "cell bigint, centroids binary"))
    n_blocks = F.create_map(*[F.lit(int(v)) for p in blocks.items() for v in p])[F.col("cell")]
    each = fitted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks.cast("bigint") - 1)))
    form = f"{key} {kind}, list bigint, d float"
    named = dealt.groupBy("cell", "block").cogroup(each.groupBy("cell", "block")).applyInArrow(name_lists, form)
    named = named.union(salted.mapInArrow(coarse(False), form))
    # a vector names at most a few lists in each of the few cells it reads
    own = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "list"))).alias("l"), F.greatest(F.min("d"), F.lit(1e-3)).alias("low"))
    own = own.select(key, "low", F.posexplode("l").alias("place", "at")).select(key, "low", "place", "at.d", "at.list")
    own = own.where((F.col("d") <= reach.ratio * F.col("low")) | (F.col("place") < reach.least))
    stored = F.lit(True) if reach.member_ratio is None else (F.col("d") <= reach.member_ratio * F.col("low")) | (F.col("place") < reach.member_least)
    own = stage(own.select(key, F.col("list").alias("cell"), stored.alias("member")))
    crowded = own.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).where("blocks > 1")
    rows = own.join(crowded, "cell", "left").join(salted, key).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.col("salt"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("cell", F.least("block", "other").alias("part_a"), F.greatest("block", "other").alias("part_b"), "block", "member", key, "vec")


#: Lists that a query reads, and that a vector is stored in.
SEARCH = Reach(ratio=1.03, least=5, member_ratio=1.02, member_least=4)


def neighbours(points: DataFrame, index: CellIndex, k: int, reach: Reach = SEARCH, min_score: float = -1.0, split: int = SPLIT_ROWS) -> DataFrame:
    """(n, other, score): for each different vector, by number, its k most similar others among the lists it reads.

    Equal scores of different vectors are told apart by their number.
    """
    dim = index.dim

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, block, member = unpacked(t.column("vec"), dim), t.column("block").to_numpy(), t.column("member").to_numpy(zero_copy_only=False)
        a, b = t.column("part_a")[0].as_py(), t.column("part_b")[0].as_py()
        stored = np.flatnonzero(member)
        q, o, s = [], [], []
        y = x[stored]
        for at in range(0, len(x), 512):
            score = x[at : at + 512] @ y.T
            rows = np.arange(at, min(at + 512, len(x)))
            score[rows[:, None] == stored[None, :]] = -2
            if a != b:  # blocks of one cell: only pairs across
                score[block[rows][:, None] == block[stored][None, :]] = -2
            if min_score > -1:
                i, j = np.nonzero(score >= min_score)
                value = score[i, j]
                order = np.lexsort((j, -value, i))
                i, j, value = i[order], j[order], value[order]
                first = np.searchsorted(i, i)
                keep = np.arange(len(i)) - first < k
                i, j, value = i[keep], j[keep], value[keep]
            else:
                m = min(k, score.shape[1])
                j = np.argsort(-score, axis=1, kind="stable")[:, :m]
                value = np.take_along_axis(score, j, 1)
                i = np.repeat(np.arange(len(rows)), m)
                j, value = j.ravel(), value.ravel()
                keep = value > -2
                i, j, value = i[keep], j[keep], value[keep]
            q.append(rows[i])
            o.append(stored[j])
            s.append(value)
        q, o, s = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (q, o, s))
        n = t.column("n").to_numpy()
        return pa.table({"n": n[q], "other": n[o], "score": s.astype(np.float32)})

    dealt = cells(points, index, reach, "n", split)
    near = dealt.groupBy("cell", "part_a", "part_b").applyInArrow(compare, "n bigint, other bigint, score float")
    # a vector has at most k rows of each of the few lists it reads; the same pair may come from several
    every = near.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("other", (-F.col("score")).alias("minus")))).alias("all"))
    once = F.filter("all", lambda x, i: (i == 0) | (F.get("all", i - 1)["other"] != x["other"]))
    best = F.slice(F.array_sort(F.transform(once, lambda x: F.struct(x["minus"], x["other"]))), 1, k)
    return every.select("n", F.explode(best).alias("b")).select("n", "b.other", (-F.col("b.minus")).cast("double").alias("score"))


def most_similar(df: DataFrame, k: int = 5, dim: int = 96, id_col: str = "id", vector_col: str = "embedding", order_col: str | None = "indexed_at", min_score: float = -1.0, **search) -> DataFrame:
    """(id, other, score, place): the k most similar other ids of each id, ties by the smaller id.

    Equal vectors are searched once: the ids that share a vector are each other's nearest (score 1), followed by
    the ids of the vector's neighbours. At most k + 1 ids of a group of equal vectors can be anybody's
    nearest, so only these are expanded; the rest take the same result.
    """
    points = prepare(df, dim, id_col, vector_col, order_col)
    single, copies = distinct_vectors(points)
    index = fit(single, dim)
    near = neighbours(single, index, k, min_score=min_score, **search)
    ids = points.select("n", "id")
    near = near.join(ids, "n").drop("n").join(ids.select(F.col("n").alias("other"), F.col("id").alias("name")), "other").select("id", F.col("name").alias("other"), "score")
    # the k + 1 smallest ids of each group of equal vectors, salted so that a large group is no one task's
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for key in (("same_as", "salt"), ("same_as",)):
        salted = salted.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("place") <= k).drop("place")
    few = stage(salted.select("same_as", F.col("id").alias("member")))
    named = few.union(few.select("same_as", F.col("same_as").alias("member")).distinct())
    # a neighbour that stands for several ids gives way to them
    wide = near.join(named, near["other"] == named["same_as"], "left").select("id", F.coalesce("member", "other").alias("other"), "score")
    own = named.select(F.col("same_as").alias("id"), F.col("member").alias("other"), F.lit(1.0).alias("score"))
    ranked = wide.union(own)
    # k + 1 places, since one of them may be the id itself
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("place") <= k + 1).drop("place")
    every = ranked.union(copies.join(ranked, copies["same_as"] == ranked["id"]).select(copies["id"], "other", "score"))
    every = every.where("id <> other")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))).where(F.col("place") <= k)
