"""Source files that do not parse.

Each file's text is tokenised and given to a generalised LL recogniser with the grammars of its language's
dialects; a file that every dialect rejects is flagged. Rows are parsed where they are read, and only
the verdicts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlode.llm.grammars import valid
from graphlode.sources.lexing import language_of
from graphlode.plans.session import spread


def verdict(text: str | None, path: str | None) -> bool | None:
    """Whether a text is valid in the language of its path; None if it is blank or of no supported language."""
    language = language_of(path)
    if language is None or not text or not text.strip():
        return None
    try:
        return valid(text, language)
    except RecursionError:  # templates nested beyond any written source
        return False


def files(df: DataFrame) -> DataFrame:
    """(project, file_path, language, valid): the verdict on the latest whole text of each file.

    df has project, file_path, qualified_name, source_code, found and retrieved_at. Whole texts are found rows whose
    qualified name is the path. Files whose latest text is blank or null and those of other languages have a null
    verdict. A null retrieved_at is the earliest; of texts retrieved at once an invalid one holds.
    """
    whole = df.where("found and qualified_name = file_path and file_path is not null")
    source = spread(whole.select("project", "file_path", "source_code", F.coalesce(F.col("retrieved_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array([language_of(p) for p in paths], pa.string()), pa.array([verdict(t, p) for t, p in zip(b.column(2).to_pylist(), paths)], pa.bool_())],
                ["project", "file_path", "at", "language", "valid"],
            )

    judged = source.mapInArrow(run, "project string, file_path string, at timestamp, language string, valid boolean")
    last = F.max(F.struct("at", F.coalesce(~F.col("valid"), F.lit(False)), "language", "valid"))
    return judged.groupBy("project", "file_path").agg(last.alias("last")).select("project", "file_path", "last.language", "last.valid")


def invalid(df: DataFrame) -> DataFrame:
    """(project, file_path): the files that every dialect of their language rejects."""
    return files(df).where("valid = false").select("project", "file_path")


def rates(df: DataFrame) -> DataFrame:
    """(project, language, files, invalid, rate) over the files with a verdict."""
    counted = files(df).where("valid is not null").groupBy("project", "language").agg(F.count("*").alias("files"), F.sum(F.when(F.col("valid"), 0).otherwise(1)).alias("invalid"))
    return counted.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
