"""Short texts of results for terminals and tools, and the schema that a query generator is told."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphlode.model import NODE_LABELS, NODES, RELATIONS

#: Rows of a result, dependencies of a report and characters of a docstring that are shown.
SHOWN_RESULTS, SHOWN_DEPENDENCIES, SHOWN_DOC = 20, 15, 100


def lines(rows: DataFrame, limit: int = SHOWN_RESULTS) -> str:
    """One line a row, at most ``limit`` of them; only those are fetched, and one more tells whether there are others."""
    got = rows.limit(limit + 1).collect()
    out = ["  ".join(f"{k}={_short(v)}" for k, v in r.asDict().items() if v is not None) for r in got[:limit]]
    if len(got) > limit:
        out.append("...")
    return "\n".join(out) or "no results"


def _short(value: object) -> str:
    text = " > ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    text = " ".join(text.split())
    return text if len(text) <= SHOWN_DOC else text[: SHOWN_DOC - 3] + "..."


def report(rows: DataFrame, symbol: str, limit: int = SHOWN_DEPENDENCIES) -> str:
    """A dependency report by direction."""
    out = [symbol]
    for direction in ("caller", "callee"):
        part = rows.where(f"direction = '{direction}'").limit(limit).collect()
        out.append(f"{direction}s: {len(part)}")
        out += [f"  {r['qualified_name']} ({r['label']}, {r['confidence']:g})" for r in part]
    return "\n".join(out)


def schema_text() -> str:
    """Labels, relations and properties, for the prompt of a query generator."""
    return "\n".join(["Labels: " + ", ".join(NODE_LABELS), "Relations: " + ", ".join(RELATIONS), "Properties: " + ", ".join(f.name for f in NODES), "Read-only queries; return single properties; scope by project."])
