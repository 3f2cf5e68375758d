"""Cutting oversized source texts into pieces at natural boundaries.

Recursive bisection: a text is cut at the strongest boundary near its middle, and every half that still
exceeds the limit less its overlap is cut again; then each piece gets the last lines of the one before it.
Boundaries are, from strong to weak: a top-level definition (its comments, decorators and attributes belong to
it), a nested definition, a blank line, any line, and within a line that alone exceeds the limit any blank or, last,
any character. Whole texts are read; nothing is cut off.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.sources.lexing import Layout, language_of
from graphlode.plans.session import spread


def boundaries(text: str, language: str | None) -> list[tuple[int, int]]:
    """(line from 0, strength 3..1) of the lines at which a text may be cut; the first definition is no boundary."""
    layout = Layout(text, language)
    strength = dict.fromkeys(range(1, len(layout.starts)), 1)
    for k in range(1, len(layout.starts)):
        if layout.inside[k]:
            strength[k] = 0
        elif layout.blank[k - 1] and not layout.blank[k]:
            strength[k] = 2
    for k, indent in layout.defines.items():
        if layout.head(k):
            strength[layout.head(k)] = 2
    for k in layout.top_level()[1:]:
        if k:
            strength[k] = 3
    return sorted(strength.items())


def definition_lines(text: str, language: str | None) -> list[int]:
    """Lines (from 1) between top-level definitions: the first line of each of them but the first."""
    lines = Layout(text, language).top_level()
    return sorted({k + 1 for k in lines[1:] if k > lines[0]})


def split(text: str, language: str | None, limit: int = 3000, overlap: int = 2) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of the pieces, lines from 1; end - start is at most ``limit``.

    A piece begins with the last ``overlap`` lines of the piece before, as far as they leave room for its own text
    (half the limit); only lines longer than that are shared in part. A text within the limit is one piece, an
    empty one gives none.
    """
    if limit < 2:
        raise ValueError("limit must be at least 2")
    if not text:
        return []
    layout = Layout(text, None)
    starts = layout.starts
    marks = boundaries(text, language) if len(text) > limit else []
    places = [starts[k] for k, _ in marks]
    rank = [s for _, s in marks]

    def shared(at: int) -> int:
        """Where a piece that begins at ``at`` begins with its overlap."""
        line = bisect_right(starts, at) - 1
        inside = at > starts[line]
        first = starts[max(0, line - overlap + (1 if inside else 0))]
        return max(first, at - limit // 2)

    out: list[tuple[int, int]] = []
    todo = [(0, len(text))]
    while todo:
        a, z = todo.pop()
        if z - (shared(a) if a else 0) <= limit:
            out.append((a, z))
            continue
        middle, quarter = (a + z) / 2, (z - a) / 4
        lo, hi = bisect_right(places, a), bisect_left(places, z)
        near = [k for k in range(lo, hi) if abs(places[k] - middle) <= quarter]
        best = max(range(lo, hi), key=lambda k: (rank[k], -abs(places[k] - middle)), default=None)
        if near:
            close = max(near, key=lambda k: (rank[k], -abs(places[k] - middle)))
            best = close if rank[close] == 3 or rank[best] < 3 else best
        if best is not None:
            cut = places[best]
        else:
            cut = text.rfind(" ", int(middle - quarter), int(middle)) + 1 or int(middle)
            cut = cut if a < cut < z else (a + z) // 2
        todo += [(cut, z), (a, cut)]
    return [(s := shared(a) if a else 0, z, bisect_right(starts, s), bisect_right(starts, z - 1)) for a, z in out]


def _mapped(df: DataFrame, id_col: str, path_col: str, text_col: str, line_col: str | None, one, names: list[str], types: list[str]) -> DataFrame:
    source = df.select(F.col(id_col).cast("string").alias("item_key"), F.col(path_col).alias("path"), F.col(text_col).alias("text"), (F.coalesce(F.col(line_col), F.lit(1)) if line_col else F.lit(1)).cast("long").alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        for b in batches:
            keys, rows = [], []
            for key, path, text, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                for row in one(text, language_of(path), first):
                    keys.append(key)
                    rows.append(row)
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array(c, kinds[t]) for c, t in zip(columns, types))], ["item_key", *names])

    return spread(source).mapInArrow(run, "item_key string, " + ", ".join(f"{n} {t}" for n, t in zip(names, types)))


def pieces(df: DataFrame, id_col: str, path_col: str = "file_path", text_col: str = "source_code", line_col: str | None = None, limit: int = 3000, overlap: int = 2) -> DataFrame:
    """(item_key, piece, first_line, last_line, start, text): the pieces of each text; null and empty texts give none.

    start is the piece's first code point in its text. One pass over the rows, no shuffle.
    """

    def one(text, language, first):
        if text:
            for i, (a, z, x, y) in enumerate(split(text, language, limit, overlap)):
                yield i, first + x - 1, first + y - 1, a, text[a:z]

    return _mapped(df, id_col, path_col, text_col, line_col, one, ["piece", "first_line", "last_line", "start", "text"], ["int", "bigint", "bigint", "int", "string"])


def places(df: DataFrame, id_col: str, path_col: str = "file_path", text_col: str = "source_code", line_col: str | None = None, limit: int = 3000) -> DataFrame:
    """(item_key, line_no): the boundaries of strength 3 that ``pieces`` cuts at first, of each text over the limit."""

    def one(text, language, first):
        for k, strength in boundaries(text, language):
            if strength == 3:
                yield (first + k,)

    return _mapped(df.where(F.length(text_col) > limit), id_col, path_col, text_col, line_col, one, ["line_no"], ["bigint"])
