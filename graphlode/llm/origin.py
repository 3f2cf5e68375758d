"""Files that the project's people did not write: generated, minified, vendored, or data saved as code.

Every row of a file gives a few figures and the fingerprints of its token stream, in one pass over the
rows; they are put together for each file. Fingerprints come from winnowing: hashes of runs of normalised tokens, of
which the least in each window is kept, so that any sufficiently long copied run shares one. Normalised: comments and layout
are gone, literals are their kind, and a name is the distance to its last occurrence within the run, so that renamed copies agree.
A file is a vendored copy by its fingerprints when those found in several other projects make up most of its weight; a fingerprint
weighs the more the fewer projects have it.

What the fingerprints cannot show, the rest tells: the path, a statement about the file itself in the comments with which a whole
file begins or ends, definitions that are numbered through, and the shape of the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.sources import lexing
from graphlode.plans.session import spread, stage

_GENERATED = re.compile(
    r"""(?ix) code\ generated\ by | @generated | auto-?\s?generated(?!\s+(?:method|function|class|constructor)\s+stub) | <auto-generated | automatically\ (?:generated|produced|created|written) | (?:generated|produced|created|written)\ automatically
    | (?:machine|tool|computer)[-\ ](?:written|generated|made)\ (?:by|with|from)
    | (?:^[\W_]*|[.:;!]\s+|\b(?:file|code|module|source)\ (?:is|was|has\ been)\ )(?:generated|compiled|transpiled)\ (?:from|by|with|using)\ \S+
    | do\ not\ (?:edit|modify|change|touch|alter)\b(?=\s*(?:[^\w\s]|$)|\s+(?:this\ file|by\ hand|manually|directly)) | (?:edits|changes|modifications)\b[^.\n]{0,40}\b(?:overwritten|lost|discarded|undone)
    | automatisch\ (?:erzeugt|generiert|erstellt) | nicht\ (?:bearbeiten|ändern|editieren)\s*(?:[^\w\s]|$) | est\ g[ée]n[ée]r[ée]e?\ (?:par|automatiquement|à\ partir) | ne\ pas\ (?:modifier|éditer)\s*(?:[^\w\s]|$) | generado\ (?:por|autom|a\ partir) | no\ (?:editar|modificar)\s*(?:[^\w\s]|$) | 自動生成 | 編集しないで"""
)
_VENDORED = re.compile(r"(?i)copied (?:verbatim|unchanged) from\b|\bimported (?:snapshot|copy|version|release) of\b|\bvendored (?:from|copy of)\b|third[- ]party (?:code|source|library|copy)\s*:|\bbundled copy\b|in sync with upstream|imported from upstream|report bugs upstream")
_VENDOR_PATH = re.compile(r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|third[_-]?party|3rdparty|godeps/_workspace|site-packages|dist-packages|carthage|pods|contrib/[^/]+-v?\d[\w.]*|submodules)/|^(?:extern|deps)/[^/]+/")
_GENERATED_PATH = re.compile(r"(?i)(?:^|/)(?:gen|generated|autogen|auto_generated|__generated__|build/stubs|generated[-_]src|src-gen)/|(?:_pb2|_pb2_grpc|\.pb|\.pb\.gw|_grpc|\.g|\.gen|\.generated|_generated|_autogen|\.auto|\.designer|_stub)\.\w+$|(?:^|/)zz_generated")
_MINIFIED_PATH = re.compile(r"(?i)(?:\.min|-min|_min\.bundle|\.bundle|\.packed)\.\w+$")
#: A name with a number of at least four digits in it; a generator's definition names its number and uses it.
_NUMBERED = re.compile(r"^[A-Za-z]+_?[A-Za-z]*_?(\d{4,})(?:_[a-z]|[A-Z]|$)")
_DEFINE = {"def", "function", "func", "fn"}
#: Names that stay themselves in a normalised stream: what their words mean is the same in any file.
_WORDS = set(
    "if else elif for while do return switch match case default break continue pass def fn func function class struct interface enum trait impl type import from export package use mod const let var mut static final public private protected pub "
    "new this self super try catch except finally raise throw throws async await yield lambda in of not and or is as with where void int string bool None null nil undefined true false True False go defer range chan map select extends implements".split()
)

#: Tokens hashed together, fingerprints' window, share of a file's weight and number of other projects that make a copy. Runs of 50 normalised
#: tokens recur by chance in hand-written code, runs of 100 do not (see README).
RUN, WINDOW, COPIED_SHARE, OTHER_PROJECTS = 100, 30, 0.5, 2


def normalised(parts: list[str], kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token by what it is, distance of each name to its last occurrence; 0 for the first one and for other tokens)."""
    last: dict[str, int] = {}
    marks, distance = np.zeros(len(parts), np.uint64), np.zeros(len(parts), np.int64)
    hashes: dict[str, int] = {}
    for i, (part, kind) in enumerate(zip(parts, kinds)):
        if kind == lexing.NAME and part not in _WORDS:
            marks[i] = 1
            if part in last:
                distance[i] = i - last[part]
            last[part] = i
        elif kind in (lexing.NUMBER, lexing.STRING):
            marks[i] = 2 + (kind == lexing.STRING)
        else:
            marks[i] = hashes.get(part) or hashes.setdefault(part, zlib.crc32(part.encode("utf-8", "replace")) | 4)
    return marks, distance


def fingerprints(marks: np.ndarray, distance: np.ndarray, run: int = RUN, window: int = WINDOW) -> np.ndarray:
    """Winnowed hashes of all runs of ``run`` normalised tokens; a name that a run has not seen before is just a name."""
    n = len(marks) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(run):
            d = distance[k : k + n]
            h = h * np.uint64(0x100000001B3) + marks[k : k + n] + np.where(d <= k, d, 0).astype(np.uint64) * np.uint64(0x9E3779B1)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    low = np.lib.stride_tricks.sliding_window_view(h, min(window, n)).min(1)
    return np.unique(low)


def head(text: str) -> str:
    """The comments (or docstring) with which a text begins."""
    m = re.match(r"""(?:\s*(?:\#!?[^\n\[]*|//[^\n]*|/\*[\s\S]*?\*/|[rRuU]?\"\"\"[\s\S]*?\"\"\"|[rRuU]?'''[\s\S]*?'''|<!--[\s\S]*?-->|package\s+[\w.]+;?(?=\s))(?=\n|\r|\Z|\s))*""", text)
    return m[0] if m else ""


def tail(text: str, tokens: list[tuple[int, int, int]]) -> str:
    """The comments (or lone strings of Python) with which a text ends."""
    i = len(tokens)
    while i:
        kind, a, b = tokens[i - 1]
        alone = kind == lexing.STRING and text[a:b].lstrip("rRuU")[:3] in ('"""', "'''") and (i == 1 or tokens[i - 2][0] in (lexing.NEWLINE, lexing.COMMENT))
        if kind not in (lexing.NEWLINE, lexing.COMMENT) and not alone:
            break
        i -= 1
    return text[tokens[i][1] :] if i < len(tokens) else ""


FIGURES = ("lines", "chars", "names", "literals", "literal_chars", "numbered", "defined", "kinds")


def features(text: str | None, path: str | None, whole: bool | None = True) -> tuple[bool, bool, tuple[int, ...], np.ndarray]:
    """(generated banner, vendored banner, FIGURES, fingerprints).

    The figures: code lines, code characters, names, literals, their characters, definitions with a number in their name that their
    text uses, all definitions, and different names.
    """
    none = np.zeros(0, np.uint64)
    if not text or not text.strip():
        return False, False, (0,) * len(FIGURES), none
    language = lexing.language_of(path) or "javascript"
    tokens = lexing.tokens(text, language)
    # what stands above or below a slice is no banner
    top = [x for x in (head(text) + "\n" + tail(text, tokens)).split("\n") if x.strip()] if whole else []
    generated = any(_GENERATED.search(x) for x in top)
    vendored = any(_VENDORED.search(x) for x in top)
    literals = literal_chars = code = 0
    lines, parts, kinds, defined, values = set(), [], [], [], set()
    line = 0
    for kind, a, b in tokens:
        if kind == lexing.NEWLINE:
            line += 1
            continue
        if kind == lexing.COMMENT:
            line += text.count("\n", a, b)
            continue
        part = text[a:b]
        code += b - a
        lines.add(line)
        if kind == lexing.NAME:
            if parts and parts[-1] in _DEFINE:
                defined.append(part)
        elif kind in (lexing.NUMBER, lexing.STRING):
            literals += 1
            literal_chars += b - a
            if kind == lexing.STRING:
                line += part.count("\n")
            elif part.isdecimal():
                values.add(int(part))
        parts.append(part)
        kinds.append(kind)
    if language == "java":  # methods have no word before them
        defined = [m[1] for m in re.finditer(r"\b(\w+)\s*\([^()]*\)\s*\{", text) if m[1] not in ("if", "for", "while", "switch", "catch", "synchronized", "try")]
    numbered = sum(1 for d in defined if (m := _NUMBERED.match(d)) and int(m[1]) in values)
    names = {p for p, k in zip(parts, kinds) if k == lexing.NAME}
    return generated, vendored, (len(lines), code, kinds.count(lexing.NAME), literals, literal_chars, numbered, len(defined), len(names)), fingerprints(*normalised(parts, kinds))


def judged(df: DataFrame) -> DataFrame:
    """(project, file_path, generated, minified, vendored, data): one row for each file, from all its rows.

    df has id, project, file_path, qualified_name, source_code and indexed_at; of several rows with one id the latest holds. Rows without
    project or path belong to no file. Null and blank sources add nothing; such a file is judged by its path.
    """
    source = spread(df.where("project is not null and file_path is not null and id is not null").select("id", F.coalesce(F.col("indexed_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), "project", "file_path", "source_code", (F.col("qualified_name") == F.col("file_path")).alias("whole")))
    types = [("generated", pa.bool_()), ("vendored", pa.bool_()), *((n, pa.int64()) for n in FIGURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t, p, w) for t, p, w in zip(*(b.column(k).to_pylist() for k in (4, 3, 5)))]
            flat_rows = [(r[0], r[1], *r[2]) for r in rows]
            columns = [pa.array([r[k] for r in flat_rows], t) for k, (_, t) in enumerate(types)]
            prints = [r[3] for r in rows]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prints])]).astype(np.int32)
            flat = np.concatenate(prints).view(np.int64) if prints else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "at", "project", "file_path", *(n for n, _ in types), "prints"])

    schema = "id string, at timestamp, project string, file_path string, generated boolean, vendored boolean, " + "".join(f"{n} bigint, " for n in FIGURES) + "prints array<bigint>"
    rows = source.withColumn("id", F.col("id").cast("string")).mapInArrow(run, schema)
    value = F.struct("project", "file_path", "generated", "vendored", *FIGURES, "prints")
    rows = stage(rows.groupBy("id").agg(F.max_by(value, F.struct("at", "chars", "project", "file_path")).alias("v")).select("v.*"))
    files = rows.groupBy("project", "file_path").agg(
        F.max("generated").alias("banner"), F.max("vendored").alias("copied"), *(F.sum(c).alias(c) for c in FIGURES)
    )
    prints = rows.select("project", "file_path", F.explode("prints").alias("print")).distinct()
    # a fingerprint's projects, two aggregations so that a common fingerprint is combined before it is shuffled; one of a single project keeps the full weight
    many = prints.select("project", "print").distinct().groupBy("print").agg(F.count("*").alias("n")).where("n > 1")
    projects = rows.agg(F.count_distinct("project")).scalar()
    weight = F.log(1 + projects / F.coalesce("n", F.lit(1)))
    copies = prints.join(many, "print", "left").groupBy("project", "file_path").agg((F.sum(F.when(F.col("n") > OTHER_PROJECTS, weight)) / F.sum(weight)).alias("recurs"))
    path = F.col("file_path")
    out = files.join(copies, ["project", "file_path"], "left")
    per_line = F.col("chars") / F.greatest(F.col("lines"), F.lit(1))
    literal = (F.col("literal_chars") > 0.55 * F.col("chars")) & (F.col("chars") > 200) & (F.col("literals") > 3 * F.col("names"))
    blob = (F.col("literal_chars") > 0.8 * F.col("chars")) & (F.col("chars") > 400) & (F.col("literal_chars") > 60 * F.col("names"))
    numbers = (F.col("literals") > 40) & (F.col("literals") > 8 * F.col("names"))
    rows_ = (F.col("literals") > 40) & (F.col("literals") > 8 * F.col("kinds")) & (F.col("literal_chars") > 0.45 * F.col("chars"))  # a table whose rows repeat a few names
    data = literal | blob | numbers | rows_
    return out.select(
        "project",
        "file_path",
        (F.col("banner") | path.rlike(_GENERATED_PATH.pattern) | ((F.col("numbered") > 0) & (2 * F.col("numbered") >= F.col("defined")))).alias("generated"),
        (path.rlike(_MINIFIED_PATH.pattern) | (~data & (per_line > 160) & (F.col("chars") > 200))).alias("minified"),
        (F.col("copied") | path.rlike(_VENDOR_PATH.pattern) | (F.coalesce("recurs", F.lit(0.0)) >= COPIED_SHARE)).alias("vendored"),
        data.alias("data"),
    )


def foreign(df: DataFrame) -> DataFrame:
    """(project, file_path): the files that are generated, minified, vendored or data."""
    return judged(df).where("generated or minified or vendored or data").select("project", "file_path")
