"""Qualified names, paths and small text functions as Spark columns (all of them run in the JVM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def build_qn(path: Column, local: Column, arity: Column | None = None) -> Column:
    """path ':' local, and '#' arity if there is one."""
    qn = F.concat_ws(":", path, local)
    return qn if arity is None else F.when(arity.isNull(), qn).otherwise(F.concat(qn, F.lit("#"), arity.cast("string")))


def qn_path(qn: Column) -> Column:
    """The part before the last colon; a name without colon is a path."""
    return F.when(F.instr(qn, ":") > 0, F.regexp_extract(qn, r"^(.*):[^:]*$", 1)).otherwise(qn)


def qn_local(qn: Column) -> Column:
    """The part after the last colon without its arity; null for a path."""
    return F.when(F.instr(qn, ":") > 0, F.regexp_replace(F.regexp_extract(qn, r":([^:]*)$", 1), r"#\d+$", ""))


def qn_arity(qn: Column) -> Column:
    return F.regexp_extract(qn, r"#(\d+)$", 1).try_cast("int")


def short_name(qn: Column) -> Column:
    return F.substring_index(F.coalesce(qn_local(qn), F.substring_index(qn, "/", -1)), ".", -1)


def container_name(qn: Column) -> Column:
    """The class part of a method's local name; null for others."""
    local = qn_local(qn)
    return F.when(F.instr(local, ".") > 0, F.regexp_extract(local, r"^(.*)\.[^.]*$", 1))


def external_qn(package: Column, name: Column) -> Column:
    return F.concat_ws(":", F.concat(F.lit("external/"), package), name)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """With its dot; '' if there is none or the name only begins with a dot."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def strip_extension(path: Column, index: bool = False) -> Column:
    """Without a source extension, and without a final /index if asked."""
    bare = F.regexp_replace(path, r"\.(?:tsx?|jsx?|mjs|cjs|py|go|rs|java|php|cs|cpp|c|h|hpp)$", "")
    return F.regexp_replace(bare, r"/index$", "") if index else bare


def resolve_relative(base_dir: Column, target: Column) -> Column:
    """The path that ``target`` with its . and .. segments means seen from ``base_dir``; .. beyond the root is dropped."""
    parts = F.split(F.concat_ws("/", F.when(base_dir != ".", base_dir), target), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def suffixes(text: Column, separator: str = "/") -> Column:
    """All trailing parts, longest first: a/b/c, b/c, c."""
    parts = F.split(text, f"[{separator}]" if separator != "/" else "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def doc_id(qn: Column) -> Column:
    """Up to 64 characters as they are, else 16 hex digits of the SHA-256, '_' and the last 47 characters."""
    return F.when(F.length(qn) <= 64, qn).otherwise(F.concat(F.substring(F.sha2(qn, 256), 1, 16), F.lit("_"), F.right(qn, F.lit(47))))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def embedding_text(qn: Column, code: Column, limit: int = 500) -> Column:
    return F.concat(qn, F.lit("\n"), F.substring(code, 1, limit))


def simple_type(text: Column) -> Column:
    """The class a type annotation is about: nulls, arrays and wrappers taken off, of a map its value."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"^:\s*", "")
    t = F.regexp_replace(t, r"\s*\|\s*(?:null|undefined|None)\b|\b(?:null|undefined|None)\s*\|\s*", "")
    t = F.regexp_replace(t, r"\?$", "")
    for _ in range(3):
        t = F.regexp_replace(t, r"(?:\[\])+$", "")
        t = F.regexp_replace(t, r"^(?:Map|Record|Dict|dict|HashMap|BTreeMap)\s*[<\[]\s*[^,<>]+,\s*(.+)[>\]]$", "$1")
        t = F.regexp_replace(t, r"^(?:Promise|Array|ReadonlyArray|Set|List|list|set|Optional|Vec|Option|Box|Rc|Arc|Awaitable|Iterable|Partial|Readonly|Required)\s*[<\[]\s*(.+)[>\]]$", "$1")
    return F.trim(F.regexp_replace(t, r"[<\[].*$", ""))


def clean_comment(text: Column) -> Column:
    """Comment and quote marks taken off."""
    t = F.regexp_replace(text, r"^\s*(?:/\*+|//+|#+|\"\"\"|''')\s*|\s*(?:\*+/|\"\"\"|''')\s*$", "")
    return F.trim(F.regexp_replace(t, r"(?m)^\s*\*\s?", ""))


def strip_jsonc(text: Column) -> Column:
    """JSON without the comments and trailing commas that configuration files have; strings are kept."""
    t = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|/\*[\s\S]*?\*/|//[^\n]*', "$1")
    return F.regexp_replace(t, r",(\s*[}\]])", "$1")


def is_entry_name(name: Column) -> Column:
    return name.rlike(r"^(main|run|handle.*|on[A-Z_].*|register.*)$")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1."""
    lines = F.split(text, "\n")
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def decode(content: Column) -> Column:
    """Bytes as UTF-8, as Latin-1 where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def first_of(columns: list[str], wanted: list[str]) -> Column:
    """The first non-blank value among those of ``wanted`` that exist in ``columns``; null if there is none."""
    there = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string")) for c in wanted if c in columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


# The C++ operator signs and the names that calls of them are given.
CPP_OPERATORS = {
    "+": "operator_plus", "-": "operator_minus", "*": "operator_multiply", "/": "operator_divide", "%": "operator_modulo",
    "=": "operator_assign", "==": "operator_equal", "!=": "operator_not_equal", "<": "operator_less", ">": "operator_greater",
    "<=": "operator_less_equal", ">=": "operator_greater_equal", "&&": "operator_logical_and", "||": "operator_logical_or",
    "&": "operator_bitwise_and", "|": "operator_bitwise_or", "^": "operator_bitwise_xor", "~": "operator_bitwise_not", "!": "operator_not",
    "<<": "operator_left_shift", ">>": "operator_right_shift", "++": "operator_increment", "--": "operator_decrement",
    "+=": "operator_plus_assign", "-=": "operator_minus_assign", "*=": "operator_multiply_assign", "/=": "operator_divide_assign",
    "%=": "operator_modulo_assign", "&=": "operator_and_assign", "|=": "operator_or_assign", "^=": "operator_xor_assign",
    "<<=": "operator_left_shift_assign", ">>=": "operator_right_shift_assign", "[]": "operator_subscript", "()": "operator_call",
}


def operator_name(sign: Column) -> Column:
    pairs = [F.lit(x) for pair in CPP_OPERATORS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[sign], F.lit("operator_unknown"))
