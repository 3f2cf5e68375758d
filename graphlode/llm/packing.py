"""Filling containers of fixed capacity with texts, sized in tokens.

The instance is reduced to a histogram: the number of items of each size below the capacity. It has
at most ``capacity`` rows however many texts there are, so solving it on the driver is bounded.

1. Dominance reduction: an item and a partner that together fill a container exactly dominate every
   other way to place the item, so as many such pairs as there are stay fixed. The same holds for the
   largest partner that fits, if no two remaining items fit beside the item together.
2. Best fit of what remains, largest size first, for whole groups of equal containers at a time.
3. Each size has its ranks dealt out to containers. The items' ranks come from counts per
   (size, salt), so a size that a third of all texts share is never in one task.

Items of size 0 (null and empty texts) need no space and go to containers by their hash. A text
larger than the capacity is divided into whole containers and one rest, no other text is divided.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlode.llm.tokens import count_tokens
from graphlode.plans.session import cut

#: Parts into which the items of one size are dealt for ranking.
SALTS = 64


class Pattern:
    """``count`` containers, each with the same items: size -> copies."""

    __slots__ = ("count", "items")

    def __init__(self, items: dict[int, int], count: int):
        self.items, self.count = items, count


def reduce_instance(have: dict[int, int], capacity: int) -> list[Pattern]:
    """Take the dominating sets out of the histogram ``have`` and return them."""
    fixed = []
    for s in [s for s in sorted(have) if 2 * s < capacity and have.get(capacity - s)]:
        n = min(have[s], have[capacity - s])
        fixed.append(Pattern({s: 1, capacity - s: 1}, n))
        have[s] -= n
        have[capacity - s] -= n
    if capacity % 2 == 0 and have.get(capacity // 2, 0) > 1:
        n = have[capacity // 2] // 2
        fixed.append(Pattern({capacity // 2: 2}, n))
        have[capacity // 2] -= 2 * n
    for s in [s for s, n in have.items() if not n]:
        del have[s]
    sizes = sorted(have)
    for s in sorted(have, reverse=True):
        while have.get(s):
            # the two smallest others decide whether more than one item can stand beside s
            low = []
            for t in sizes:
                if have.get(t):
                    low += [t] * min(2, have[t] - (t == s))
                if len(low) >= 2:
                    break
            if len(low) >= 2 and s + low[0] + low[1] <= capacity:
                break
            partner = next((t for t in reversed(sizes) if have.get(t, 0) > (t == s) and s + t <= capacity), None)
            if partner is None:
                fixed.append(Pattern({s: 1}, have.pop(s)))
                continue
            n = have[s] // 2 if partner == s else min(have[s], have[partner])
            fixed.append(Pattern({s: 2} if partner == s else {s: 1, partner: 1}, n))
            have[s] -= 2 * n if partner == s else n
            if partner != s:
                have[partner] -= n
            for t in (s, partner):
                if not have.get(t, 1):
                    have.pop(t)
        if have.get(s):
            break  # smaller items only have more room beside them
    return fixed


def best_fit(have: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit, largest size first; equal open containers are kept as one group.

    A size either uses up a group or ends within one, so there are at most about two groups a size.
    """
    done: list[Pattern] = []
    room: list[int] = []  # sorted spaces of open groups
    groups: dict[int, list[Pattern]] = {}

    def put(p: Pattern, space: int) -> None:
        if not space:
            done.append(p)
            return
        if space not in groups:
            groups[space] = []
            insort(room, space)
        groups[space].append(p)

    for s in sorted(have, reverse=True):
        n = have[s]
        while n:
            at = bisect_left(room, s)
            if at == len(room):
                q = capacity // s
                if n >= q:
                    put(Pattern({s: q}, n // q), capacity - q * s)
                if n % q:
                    put(Pattern({s: n % q}, 1), capacity - (n % q) * s)
                break
            space = room[at]
            p = groups[space].pop()
            if not groups[space]:
                del groups[space], room[at]
            if p.count > n:
                put(Pattern(dict(p.items), p.count - n), space)
                p.count = n
            n -= p.count
            p.items[s] = p.items.get(s, 0) + 1
            put(p, space - s)
    return done + [p for ps in groups.values() for p in ps]


def solve(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(rows (size, first rank, end rank, first container, copies a container), number of containers)."""
    have = {s: n for s, n in histogram.items() if n > 0}
    patterns = reduce_instance(have, capacity)
    patterns += best_fit(have, capacity)
    used: dict[int, int] = {}
    rows, container = [], 0
    for p in patterns:
        for s, copies in p.items.items():
            a = used.get(s, 0)
            used[s] = a + copies * p.count
            rows.append((s, a, used[s], container, copies))
        container += p.count
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), container


def pack(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, piece, first_token, n_tokens, container): one row for each item in its container.

    Rows without an id are left out; a row that repeats an id is an item of its own (its whole containers are told apart by
    the id only, so ids should be unique). container is 'w:<id>:<piece>' for a container that a divided text fills alone
    and 'm:<number>' for the others. An empty table gives no rows.
    """
    sizes = cut(count_tokens(df.where(F.col(id_col).isNotNull()), id_col, text_col, vocabulary))
    rest = sizes.withColumn("size", F.col("n_tokens") % capacity).withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    counts = rest.groupBy("size", "salt").agg(F.count("*").alias("n"))
    # bounded by capacity * SALTS rows
    counts = cut(counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    histogram = {r["size"]: r["n"] for r in counts.filter("size > 0").groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan, containers = solve(histogram, capacity)
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy(id_col)) - 1
    ranked = (
        rest.filter("size > 0")
        .withColumn("within", within)
        .join(counts.select("size", "salt", "before"), ["size", "salt"])
        .select(id_col, "n_tokens", "size", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    )
    kind = ranked.schema[id_col].dataType.simpleString()
    starts = plan[:, 0] * (1 << 40) + plan[:, 1] if len(plan) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            row = plan[np.searchsorted(starts, size * (1 << 40) + rank, side="right") - 1]
            where = row[:, 3] + (rank - row[:, 1]) // row[:, 4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(where, pa.int64())], [id_col, "n_tokens", "size", "where"])

    mixed = ranked.mapInArrow(place, f"`{id_col}` {kind}, n_tokens bigint, size bigint, where bigint").select(
        id_col,
        F.floor(F.col("n_tokens") / capacity).cast("int").alias("piece"),
        (F.col("n_tokens") - F.col("size")).alias("first_token"),
        F.col("size").alias("n_tokens"),
        F.concat(F.lit("m:"), F.col("where").cast("string")).alias("container"),
    )
    whole = (
        sizes.filter(F.col("n_tokens") >= capacity)
        .select(id_col, F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / capacity) - 1).cast("int"))).alias("piece"))
        .select(id_col, "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat(F.lit("w:"), F.col(id_col).cast("string"), F.lit(":"), F.col("piece").cast("string")).alias("container"))
    )
    empty = sizes.filter("n_tokens = 0").select(
        id_col, F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), F.concat(F.lit("m:"), F.pmod(F.xxhash64(id_col), F.lit(max(1, containers))).cast("string")).alias("container")
    )
    return mixed.unionByName(whole).unionByName(empty)
