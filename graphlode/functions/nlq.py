"""The question front end: cleaning and checking of generated query text, routing, truncation, results for tools."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlode.operators.mutate import token_budget
from graphlode.sources.extract import BUILTINS

DEFAULT_LIMIT, ROW_CAP, TOKEN_CAP = 50, 500, 8000
# The keywords that a read-only query must not hold.
DANGEROUS = ("DELETE", "DETACH", "DROP", "CREATE INDEX", "CREATE CONSTRAINT", "REMOVE", "SET", "MERGE", "CREATE", "CALL", "LOAD CSV", "FOREACH")


class InvalidQuery(ValueError):
    """A query text that must not run."""


def clean(text: str) -> str:
    """The query in a model's answer: fences, headings, inline quotes, a language word and the last semicolon go."""
    fenced = re.search(r"```(?:cypher|sql)?\s*\n?([\s\S]*?)```", text, re.IGNORECASE)
    out = (fenced[1] if fenced else text).strip()
    out = re.sub(r"^\s*\*\*[^*\n]+\*\*:?\s*", "", out).strip().strip("`").strip()
    out = re.sub(r"^cypher\b[:\s]*", "", out, flags=re.IGNORECASE)
    return out.rstrip().rstrip(";").rstrip()


def without_literals(text: str) -> str:
    """The text with strings, quoted names and comments emptied."""
    return re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|//[^\n]*|/\*[\s\S]*?\*/", " ", text)


def check_read_only(text: str) -> str:
    bare = re.sub(r"\s+", " ", without_literals(text)).upper()
    for word in DANGEROUS:
        if re.search(rf"(?<![\w.:$]){word}(?![\w(])|(?<![\w.:$]){word}(?=\s*\()", bare):
            raise InvalidQuery(f"query is not read-only: {word}")
    return text


def check_lists(text: str, list_properties: frozenset[str] = frozenset({"decorators", "parameters", "trace", "members"})) -> str:
    """IN and ANY need a list on the right: a scalar property there is an error."""
    bare = without_literals(text)
    for m in re.finditer(r"\bIN\s+\w+\.(\w+)", bare, re.IGNORECASE):
        if m[1] not in list_properties:
            raise InvalidQuery(f"{m[1]} is not a list")
    return text


def check(text: str) -> str:
    if not re.search(r"\bMATCH\b", without_literals(text), re.IGNORECASE):
        raise InvalidQuery("query has no MATCH")
    return check_lists(check_read_only(text))


# The labels whose variables are scoped in query text.
_SCOPED = {"Module", "Class", "Function", "Method", "Interface", "Enum", "Type", "Comment", "Literal", "Builtin"}


def scope(text: str, project: str | None) -> tuple[str, dict[str, str]]:
    """The text form of project scoping: a condition on each variable with a code label; parameters are returned with it.

    Texts that mention the project already, or have no such variable, stay. Queries that this engine runs are scoped at
    their sources instead, which also holds for unions and later clauses.
    """
    if not project or re.search(r"\$project\b|\.project\b", text, re.IGNORECASE):
        return text, {}
    found = re.findall(r"\(([A-Za-z_]\w*)\s*:\s*([A-Za-z_|]+)\)", text)
    variables = list(dict.fromkeys(v for v, labels in found if _SCOPED & set(labels.split("|"))))
    body = text.strip().removesuffix(";")
    end = re.search(r"\bRETURN\b", body, re.IGNORECASE)
    if not variables or not end:
        return text, {}
    condition = " AND ".join(f"{v}.project = $project" for v in variables)
    head, tail = body[: end.start()], body[end.start() :]
    where = re.search(r"\bWHERE\b", head, re.IGNORECASE)
    if where:
        head = f"{head[: where.end()]} {condition} AND ({head[where.end() :].strip()})"
    else:
        head = f"{head}WHERE {condition}"
    return f"{head}\n{tail};", {"project": project}


# -- routing ---------------------------------------------------------------------------------------------------
@dataclass
class Route:
    kind: str  # graph, dependency, semantic, exact_text, grep_recommended or unsupported
    symbol: str | None = None
    direction: str = "both"
    depth: int = 1


def route(question: str) -> Route:
    """A deterministic router by the question's words; symbols are the identifiers it quotes or spells in code."""
    q = question.strip()
    low = q.lower()
    if re.search(r"\b(delete|drop|remove|rename|refactor|write|commit|deploy)\b.*\b(all|file|graph|project|node|function|class)", low):
        return Route("unsupported")
    m = re.search(r"[`'\"]([\w$.:/@-]+)[`'\"]", q) or re.search(r"\b([A-Z][A-Z0-9]*_[A-Z0-9_]+|\w+\.\w+(?:\.\w+)*|[a-z]+[A-Z]\w*|[A-Z][a-z0-9]+[A-Z]\w*|[A-Z]{2,}[a-z]\w*[A-Z]\w*|\w+_\w+)(?:\(\))?", q)
    symbol = m[1] if m else None
    stated = re.search(r"depth\s*(?:<=|≤|of|up to)?\s*(\d+)", low)
    depth = int(stated[1]) if stated else 3 if re.search(r"\btransitive|\bindirect", low) else 1
    depth = max(1, min(3, depth))
    if re.search(r"\b(regex|grep|readmes?|package-lock|lock ?files?|changelogs?|every file|all files|docs)\b", low):
        return Route("grep_recommended", symbol)
    if symbol in BUILTINS or re.search(r"\b(todo|fixme|comments?|string literals?|literals?|hard-?coded)\b", low):
        return Route("exact_text", symbol)
    calling = re.search(r"\b(calls?|called|callers?|callees?|uses?|used|depend\w*|blast radius|impact)\b", low)
    if symbol and calling:
        inward = re.search(r"\bcallers?\b|\bused by\b|\bwho (?:calls|uses)\b|\bwhat (?:calls|uses)\b|\b(?:calls|uses)\s+[`'\"]?" + re.escape(symbol), q, re.IGNORECASE)
        outward = re.search(r"\bcallees?\b|\bdoes\b.*\bcall\b|\bcalled by\b", low)
        return Route("dependency", symbol, "callers" if inward and not outward else "callees" if outward else "both", depth)
    if re.search(r"\b(similar|about|related to|semantic|concept|code that|code which|logic|how (?:is|are|does|do))\b", low):
        return Route("semantic", symbol)
    return Route("graph", symbol, depth=depth)


def repair(generate: Callable[[str], str], question: str, attempts: int = 1) -> str:
    """Generate, clean and check; an invalid text is given back with its error up to ``attempts`` times."""
    prompt = question
    for n in range(attempts + 1):
        text = clean(generate(prompt))
        try:
            return check(text)
        except InvalidQuery as error:
            if n == attempts:
                raise
            prompt = f"{question}\nThis query was rejected ({error}): {text}"
    raise AssertionError


# -- results ---------------------------------------------------------------------------------------------------
def row_tokens() -> Column:
    return F.ceil(F.length(F.to_json(F.struct("*"))) / 4)


def capped(rows: DataFrame, order: list[str], cap: int = ROW_CAP) -> tuple[DataFrame, DataFrame]:
    """(the first rows, (total, returned, was_truncated) as one row)."""
    total = rows.agg(F.count("*").alias("total"))
    meta = total.select("total", F.least("total", F.lit(cap)).cast("long").alias("returned"), (F.col("total") > cap).alias("was_truncated"))
    return rows.orderBy(*order).limit(cap), meta


def truncated(rows: DataFrame, order: list[str], cap: int = ROW_CAP, tokens: int = TOKEN_CAP) -> DataFrame:
    """At most ``cap`` rows whose JSON stays within the token budget; the first row beyond it ends the result."""
    first = rows.orderBy(*order).limit(cap)
    return token_budget(first.withColumn("_json", F.to_json(F.struct(*rows.columns))), order, F.col("_json"), tokens).drop("_json")


def estimate_tokens(text: str) -> int:
    return math.ceil(len(text) / 4)


@dataclass
class Answer:
    """What a question came to: the query, its rows, and an error instead of them."""

    question: str
    query: str | None = None
    rows: DataFrame | None = None
    error: str | None = None
    meta: dict[str, object] = field(default_factory=dict)
