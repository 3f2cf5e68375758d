"""The graph on disk: Parquet tables partitioned by project and label or relation, file hashes, vectors, exports.

There is no table format with updates in place. A write replaces the partitions that it touches (dynamic partition
overwrite); a table that is read and written in one step goes through a staged copy first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlode.model import EDGES, FILE_HASHES, NODES, VECTORS
from graphlode.operators.graph import Graph, counts
from graphlode.plans.session import exists, recover, remove, stage, swap


def quote(project: str) -> str:
    """A project's name as Spark writes it in the folder of its partition."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or ord(c) < 32 else c for c in project)


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _read(self, name: str, schema) -> DataFrame:
        """The table, empty with its schema if it does not exist yet."""
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    @staticmethod
    def _shaped(df: DataFrame, schema) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _write(self, df: DataFrame, name: str, schema, *partitions: str) -> None:
        kept = stage(self._shaped(df, schema))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.root}/{name}")

    def graph(self) -> Graph:
        return Graph(self._read("nodes", NODES), self._read("edges", EDGES))

    def hashes(self) -> DataFrame:
        return self._read("file_hashes", FILE_HASHES)

    def vectors(self) -> DataFrame:
        return self._read("vectors", VECTORS)

    def replace_project(self, project: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Both tables of the project as a whole: written beside the old ones, which they replace once both are complete.

        A failure while writing leaves the old project as it was. One between the two moves leaves an old or a new table of each
        kind, never none (see ``recover``), and the hashes of the old state, so that the next run makes it good.
        """
        parts = (("nodes", nodes, NODES, "label"), ("edges", edges, EDGES, "rel_type"))
        beside = f"{self.root}/_next-{uuid.uuid4().hex}"
        try:
            for name, df, schema, part in parts:
                self._shaped(df.where(F.col("project") == project), schema).drop("project").write.partitionBy(part).parquet(f"{beside}/{name}")
            for name, *_ in parts:
                swap(self.spark, f"{beside}/{name}", f"{self.root}/{name}/project={quote(project)}")
        finally:
            remove(self.spark, beside)

    def recover(self, project: str) -> None:
        """Bring back tables of a project whose replacement was cut off; called before a project is indexed."""
        for name in ("nodes", "edges", "vectors"):
            recover(self.spark, f"{self.root}/{name}/project={quote(project)}")

    def commit_hashes(self, project: str, hashes: DataFrame) -> None:
        """Only after nodes and edges are written: a failed run is indexed again."""
        self._write(hashes, "file_hashes", FILE_HASHES, "project")

    def write_vectors(self, vectors: DataFrame) -> None:
        self._write(vectors, "vectors", VECTORS, "project")

    def replace_vectors(self, project: str, vectors: DataFrame) -> None:
        """All vectors of the project, written beside the old ones and then put in their place."""
        beside = f"{self.root}/_next-{uuid.uuid4().hex}"
        try:
            self._shaped(vectors, VECTORS).drop("project").write.parquet(beside)
            swap(self.spark, beside, f"{self.root}/vectors/project={quote(project)}")
        finally:
            remove(self.spark, beside)

    def delete_project(self, project: str) -> None:
        """Drop every partition of the project, in all tables: nothing of it stays."""
        for name in ("nodes", "edges", "file_hashes", "vectors"):
            self._drop(f"{name}/project={quote(project)}")

    def clear(self) -> None:
        for name in ("nodes", "edges", "file_hashes", "vectors"):
            self._drop(name)

    def _drop(self, path: str) -> None:
        remove(self.spark, f"{self.root}/{path}")

    def export(self, folder: str) -> DataFrame:
        """The whole graph as JSON lines, nodes and edges apart; (nodes, edges, exported_at) as one row."""
        g = self.graph()
        g.nodes.write.mode("overwrite").json(f"{folder}/nodes")
        g.edges.write.mode("overwrite").json(f"{folder}/edges")
        return counts(g).withColumn("exported_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
