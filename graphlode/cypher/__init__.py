"""A read-only subset of openCypher, compiled to DataFrames."""

from graphlode.cypher.compiler import run

__all__ = ["run"]
