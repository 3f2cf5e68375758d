"""Long passages that occur word for word in more than one text.

MinHash banding of paragraphs, with every stretch of ``least`` characters as a paragraph: its
signature is the least hash among its shingles of ``shingle`` characters. One band of one row gives
recall 1 for equal paragraphs, since equal stretches have equal shingles; consecutive stretches mostly
share their signature, so a text has only a few dozen signatures in a thousand characters. Texts
with a colliding signature are verified by the characters of their stretches, never by estimate, and
texts linked by a shared passage form clusters by components. Hashes of stretches only bring equal ones together: a run of
stretches counts as shared when its characters are compared and equal (in over HOT_TEXTS texts: when their SHA-256 is).

Bands over whole written paragraphs cannot take this place: a passage of 200 characters within two long paragraphs leaves
their word shingles mostly different. See the README for the recall of such bands.

Whole copies are found first by their text's digest and keep one representative, so that a text copied
into a third of all rows is compared once. Positions count in code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.llm.components import connected_components
from graphlode.plans.session import spread, stage

#: Signatures of candidates that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST_SIGNATURES = 1_000_000
#: Texts with the same signature that are verified side by side; stretches of one in more texts are counted each.
HOT_TEXTS = 4_096
_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                self.up = np.concatenate([one, np.cumprod(np.full(n, self.base, np.uint64))])
                self.down = np.concatenate([one, np.cumprod(np.full(n, pow(self.base, -1, 1 << 64), np.uint64))])
            self.n = n
        return self.up, self.down


_POWERS = _Powers(_BASE)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(11)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each stretch of ``width`` code points, by prefix sums modulo 2**64."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * codes * up[: len(codes)], out=sums[1:])
        return _mix((sums[width:] - sums[:-width]) * down[:n])


def _sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over each stretch of ``width`` values, by doubling."""
    done = 1
    while done * 2 <= width:
        a = op(a[: len(a) - done], a[done:])
        done *= 2
    rest = width - done
    return op(a[: len(a) - rest], a[rest:]) if rest else a


def signatures(codes: np.ndarray, least: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, least hash of each stretch of ``least`` code points)."""
    h = window_hashes(codes, shingle)
    width = least - shingle + 1
    return h, _sliding(np.minimum, h, width) if len(h) >= width else np.zeros(0, np.uint64)


def _flat(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    for i, t in enumerate(texts):
        if t:
            yield i, code_points(t)


def same_characters(texts: list[str], s: np.ndarray, w: np.ndarray, row: np.ndarray, offset: np.ndarray, least: int) -> bool:
    """Whether all stretches with one hash (and signature) have the characters of the first of them."""
    order = np.lexsort((w, s))
    new = np.concatenate([[True], (w[order][1:] != w[order][:-1]) | (s[order][1:] != s[order][:-1])]) if len(w) else np.zeros(0, bool)
    head = np.empty(len(w), np.int64)
    head[order] = order[new][np.cumsum(new) - 1]
    other, at = row[head], offset[head]
    # runs of stretches whose first ones are a run too are compared at once; rows are in order of row and offset
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (at[1:] != at[:-1] + 1)])) if len(w) else np.zeros(0, np.int64)
    last = np.concatenate([cut[1:], [len(w)]]).astype(np.int64) - 1 if len(w) else cut
    for a, z in zip(cut.tolist(), last.tolist()):
        i, k = row[a], other[a]
        if (i != k or offset[a] != at[a]) and texts[i][offset[a] : offset[z] + least] != texts[k][at[a] : at[z] + least]:
            return False
    return True


def copies_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, copy_of): each row whose whole text occurs under a smaller id."""
    keyed = df.select(id_col, F.unhex(F.sha2(F.col(text_col), 256)).alias("digest"), F.length(text_col).alias("n"))
    many = keyed.groupBy("digest", "n").agg(F.min(id_col).alias("copy_of"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    return keyed.join(many, ["digest", "n"]).where(F.col(id_col) != F.col("copy_of")).select(id_col, "copy_of")


def shared_stretches(df: DataFrame, least: int = 200, shingle: int = 60, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, hits): hits (id, first, start, stop, g1, g2) are texts' stretches that begin at start..stop and occur in another text.

    first is the least id that holds the stretch, (g1, g2) the digest of the set of all that hold it. Signatures in up to HOT_TEXTS texts bring the
    surroundings of their shingle together and are verified there; a signature in more texts has each of
    its stretches counted on its own, by distributed aggregation, so that no task gathers its texts.
    """
    if not 1 < shingle <= least:
        raise ValueError("shingle must be within the least length")
    base = df.select(id_col, text_col).where(F.col(id_col).isNotNull() & (F.length(text_col) >= least))
    kind = base.schema[id_col].dataType.simpleString()
    copies = stage(copies_of(base, id_col, text_col))
    single = base.join(copies.select(id_col), id_col, "left_anti")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, codes in _flat(b.column(1).to_pylist()):
                found = np.unique(signatures(codes, least, shingle)[1])
                out.append(found)
                ids.append(np.full(len(found), i))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(out).view(np.int64))], [id_col, "signature"])

    signed = stage(spread(single).mapInArrow(sign, f"`{id_col}` {kind}, signature bigint"))
    colliding = signed.groupBy("signature").agg(F.count("*").alias("texts")).where("texts > 1").select("signature", (F.col("texts") > HOT_TEXTS).alias("hot"))
    wanted = stage(signed.join(colliding, "signature").groupBy(id_col).agg(F.collect_list(F.struct("signature", "hot")).alias("signatures")))
    total, hot = wanted.agg(F.coalesce(F.sum(F.size("signatures")), F.lit(0)), F.coalesce(F.max(F.exists("signatures", lambda s: s["hot"])), F.lit(False))).first()
    candidates = single.join(F.broadcast(wanted) if total <= BROADCAST_SIGNATURES else wanted, id_col).select(id_col, text_col, "signatures")
    reach = least - shingle

    def pick(codes: np.ndarray, entry: pa.Scalar, hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each shingle, least hash of each stretch, sorted signatures wanted)."""
        flags = entry.values.field("hot").to_numpy(zero_copy_only=False)
        mine = np.sort(entry.values.field("signature").to_numpy()[flags == hot].view(np.uint64))
        return (*signatures(codes, least, shingle), mine)

    def within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(sorted_values):
            return np.zeros(len(values), bool)
        return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each surrounding of a wanted signature, from ``reach`` before its shingle to ``least`` after its start, and its places."""
        for b in batches:
            owner, sign, at, ctx, size = [], [], [], [], 0
            for i, text in enumerate(b.column(1).to_pylist()):
                h, low, mine = pick(code_points(text), b.column(2)[i], False)
                if not len(mine):
                    continue
                places = np.flatnonzero(within(mine, h))
                # only where the shingle is the least of some stretch around it
                high = _sliding(np.maximum, np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)]), reach + 1)
                places = places[high[places] == h[places]]
                same: dict[str, list[int]] = {}  # a text that repeats itself brings each surrounding once
                for p in places.tolist():
                    same.setdefault(text[max(0, p - reach) : p + least], []).append(p)
                for around, where in same.items():
                    owner.append(i)
                    sign.append(h[where[0]])
                    at.append(where)
                    ctx.append(around)
                    size += least + 4 * len(where)
                if size > 8_000_000:
                    yield out(b, owner, sign, at, ctx)
                    owner, sign, at, ctx, size = [], [], [], [], 0
            if owner:
                yield out(b, owner, sign, at, ctx)

    def out(b, owner, sign, at, ctx) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), pa.array(np.array(sign, np.uint64).view(np.int64)), pa.array(at, pa.list_(pa.int32())), pa.array(ctx, pa.string())], [id_col, "signature", "at", "around"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by signature; whole groups are compared by the content of their stretches."""
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            sign = b.column(1).to_numpy()
            cut = int(np.searchsorted(sign, sign[-1])) if len(sign) else 0  # the last group may go on
            if cut == 0 or rows + cut < 4000:
                held.append(b)
                rows += b.num_rows
                continue
            yield from compare(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        t = t.combine_chunks()
        sign, at = t.column(1).to_numpy(), t.column(2).to_pylist()
        ids = t.column(0).combine_chunks() if isinstance(t.column(0), pa.ChunkedArray) else t.column(0)
        rank = pa.compute.rank(ids, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        around = t.column(3).to_pylist()
        one = ids.take(pa.array(np.unique(rank, return_index=True)[1])).to_pylist()
        digest = np.frombuffer(b"".join(hashlib.md5(str(v).encode("utf-8", "surrogatepass")).digest() for v in one), np.int64).reshape(-1, 2)
        begin = 0
        while begin < len(around):  # about a million characters at once, never within a group
            end, size = begin, 0
            while end < len(around) and (size < 1_000_000 or sign[end] == sign[end - 1]):
                size += len(around[end])
                end += 1
            lengths = np.array([len(a) for a in around[begin:end]])
            w = window_hashes(code_points("".join(around[begin:end])), least)
            starts = np.cumsum(lengths) - lengths
            n = np.maximum(lengths - least + 1, 0)
            row = np.repeat(np.arange(end - begin), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = w[np.repeat(starts, n) + offset]
            s, r = sign[begin:end][row], rank[begin:end][row]
            if not same_characters(around[begin:end], s, w, row, offset, least):  # two stretches with one hash: their characters tell
                number: dict[str, int] = {}
                w = np.array([number.setdefault(around[begin + i][o : o + least], len(number)) for i, o in zip(row.tolist(), offset.tolist())], np.uint64)
            order = np.lexsort((r, w, s))
            w, s, r, row, offset = w[order], s[order], r[order], row[order], offset[order]
            new = np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])]) if len(w) else np.zeros(0, bool)
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(w)]]).astype(np.int64) - 1 if len(first) else first
            both = (r[first] != r[last])[group] if len(first) else np.zeros(0, bool)
            holder = row[first][group][both] if len(first) else np.zeros(0, np.int64)
            if len(first):
                counted = new | np.concatenate([[True], r[1:] != r[:-1]])  # each holder of a stretch once
                sets = np.bitwise_xor.reduceat(np.where(counted[:, None], digest[r - 1], 0), first, axis=0)[group][both]
            row, start = row[both], offset[both]
            order = np.lexsort((start, holder, row))
            row, start, holder = row[order], start[order], holder[order]
            if len(row):
                sets = sets[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (holder[1:] != holder[:-1]) | (start[1:] != start[:-1] + 1) | (sets[1:] != sets[:-1]).any(1)])
                a = np.flatnonzero(new)
                z = np.concatenate([a[1:], [len(row)]]) - 1
                runs = row[a]
                shift = [[max(0, p - reach) for p in at[begin + k]] for k in runs.tolist()]
                each = np.array([len(x) for x in shift])
                shift = np.array([p for x in shift for p in x], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(begin + runs, each))), ids.take(pa.array(np.repeat(begin + holder[a], each))),
                        pa.array((np.repeat(start[a], each) + shift).astype(np.int32)), pa.array((np.repeat(start[z], each) + shift).astype(np.int32)),
                        pa.array(np.repeat(sets[a, 0], each)), pa.array(np.repeat(sets[a, 1], each)),
                    ], [id_col, "first", "start", "stop", "g1", "g2"])
            begin = end

    hits_type = f"`{id_col}` {kind}, first {kind}, start int, stop int, g1 bigint, g2 bigint"
    places = candidates.mapInArrow(surround, f"`{id_col}` {kind}, signature bigint, at array<int>, around string")
    hits = places.repartition("signature").sortWithinPartitions("signature").mapInArrow(verify, hits_type)
    if not hot:
        return copies, hits

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1).to_pylist()):
                codes = code_points(text)
                _, low, mine = pick(codes, b.column(2)[i], True)
                at = np.flatnonzero(within(mine, low))
                if not len(at):
                    continue
                digests = [hashlib.sha256(text[p : p + least].encode("utf-8", "surrogatepass")).digest() for p in at.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(digests, pa.binary()), pa.array(at.astype(np.int32))], [id_col, "digest", "at"])

    windows = stage(candidates.mapInArrow(expand, f"`{id_col}` {kind}, digest binary, at int"))
    sets = [F.bit_xor(F.xxhash64(F.lit(n), id_col)).alias(f"g{n}") for n in (1, 2)]
    twice = windows.select("digest", id_col).distinct().groupBy("digest").agg(F.min(id_col).alias("first"), F.max(id_col).alias("b"), *sets).where("first <> b").drop("b")
    return copies, hits.union(windows.join(twice, "digest").select(id_col, "first", F.col("at").alias("start"), F.col("at").alias("stop"), "g1", "g2"))


def found(df: DataFrame, least: int = 200, shingle: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col): each row with ``least`` consecutive characters that occur unchanged in another row's text.

    Null, empty and shorter texts and rows without an id are never among them. Of rows that repeat an id with the same
    text nothing is shared by that alone.
    """
    copies, hits = shared_stretches(df, least, shingle, id_col, text_col)
    return hits.select(id_col).union(copies.select(id_col)).union(copies.select("copy_of")).distinct()


def linked(held: DataFrame) -> DataFrame:
    """(a, links): the number of other texts in the sets (g1, g2) of holders that each text a is in.

    The size of its set is enough for a text in one set; only those in several have their sets brought together.
    """
    held = stage(held.distinct())
    many = held.groupBy("a").agg(F.count("*").alias("sets")).where("sets > 1").select("a")
    sizes = held.groupBy("g1", "g2").agg((F.count("*") - 1).alias("links"))
    single = held.join(many, "a", "left_anti").join(sizes, ["g1", "g2"]).select("a", "links")
    others = held.join(many, "a", "left_semi").join(held.withColumnRenamed("a", "b"), ["g1", "g2"]).where("a <> b").select("a", "b").distinct()
    return single.union(others.groupBy("a").agg(F.count("*").alias("links")))


def spans(df: DataFrame, least: int = 200, shingle: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, spans, shared_chars, share, cluster, links): one row for each text with a shared passage.

    spans are the maximal [start, end) code-point ranges made of shared stretches; cluster is the least id
    of the texts linked through shared passages, links the number of all other different texts that a text shares a passage
    with (exact copies count once, as their representative, and have its links).
    A copy's span is its whole text. Null, empty and short texts hold nothing and give no row.
    """
    copies, hits = shared_stretches(df, least, shingle, id_col, text_col)
    hits = stage(hits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for runs in b.column(1).to_pylist():
                mine: list[dict[str, int]] = []
                for r in sorted((r["start"], r["stop"] + least) for r in runs):
                    if mine and r[0] <= mine[-1]["end"]:
                        mine[-1]["end"] = max(mine[-1]["end"], r[1])
                    else:
                        mine.append({"start": r[0], "end": r[1]})
                out.append(mine)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [id_col, "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    span = "array<struct<start:int,end:int>>"
    merged = hits.groupBy(id_col).agg(F.collect_set(F.struct("start", "stop")).alias("runs")).mapInArrow(merge, f"`{id_col}` {kind}, spans {span}")
    pairs = hits.where(F.col(id_col) != F.col("first")).select(F.col(id_col).alias("a"), F.col("first").alias("b")).distinct()
    copied = copies.select(F.col(id_col).alias("a"), F.col("copy_of").alias("b"))
    links = linked(hits.select(F.col(id_col).alias("a"), "g1", "g2"))
    links = stage(links.union(copied.join(links.withColumnRenamed("a", "b"), "b").select("a", "links"))).withColumnRenamed("a", id_col)
    cluster = connected_components(pairs.union(copied)).select(F.col("node").alias(id_col), F.col("component").alias("cluster"))
    lengths = df.select(id_col, F.length(text_col).alias("n_chars"))
    whole = copies.select(id_col).union(copies.select("copy_of")).distinct().withColumn("whole", F.lit(True))
    out = cluster.join(lengths, id_col).join(whole, id_col, "left").join(merged, id_col, "left").join(links, id_col, "left")
    full = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end")))
    out = out.withColumn("spans", F.when(F.col("whole"), full).otherwise(F.col("spans")))
    shared = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return out.select(id_col, "n_chars", "spans", shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"), "cluster", F.coalesce("links", F.lit(0)).alias("links"))
