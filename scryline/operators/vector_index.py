"""A stored inverted-file index of vectors (IDs O05, O06, X04, S16).

Cells are k-means clusters of directions, fitted on a bounded sample (SAMPLE_VECTORS, by least hash of the id); every vector is stored in its
nearest cell. A query looks into the `probes` nearest cells and ranks what it finds there by exact cosine similarity. What it misses lies in other cells:
`recall` measures that against exact search, which retrieval.knn stays the default for.

The cells are folders, so a search reads the chosen ones alone; a cell's vectors are several files, so one with most vectors is many
tasks' work. Vectors added later go to the cells that are there, as a segment of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from scryline.operators.retrieval import QUERY_BLOCK, knn, nearest, top_k
from scryline.sources.versions import Manifests

SAMPLE_VECTORS, ROUNDS, MOST_CELLS = 100_000, 15, 4_096


def fit_cells(vectors: DataFrame, cells: int) -> list[list[float]]:
    """Centres of the sample's directions, by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = vectors.where("vector is not null").select(F.xxhash64("doc").alias("_h"), "doc", array_to_vector(F.col("vector").cast("array<double>")).alias("features")).orderBy("_h", "doc").limit(SAMPLE_VECTORS)
    model = KMeans(k=cells, maxIter=ROUNDS, seed=1, distanceMeasure="cosine").fit(chosen.where(cosine_defined("features")))
    return [c.tolist() for c in model.clusterCenters()]


def cosine_defined(features: str):
    """Vectors that are zero have no direction."""
    from pyspark.ml.functions import vector_to_array

    return F.exists(vector_to_array(features), lambda x: x != 0)


class VectorIndex:
    """An index of vectors (doc, vector)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, path)

    def _state(self) -> dict:
        state = self.manifests.newest()[1]
        if not state:
            raise FileNotFoundError(self.path)
        return state

    def _assigned(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        """vectors with their cell; the centres travel with the plan, at most MOST_CELLS of them."""
        unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        shared = self.spark.sparkContext.broadcast(unit)

        @F.pandas_udf("int")
        def cell(vector: pd.Series) -> pd.Series:
            held = vector.notna().to_numpy()
            out = np.zeros(len(vector), np.int32)
            if held.any():
                out[held] = (np.stack(vector[held].to_numpy()).astype(np.float64) @ shared.value.T).argmax(axis=1)
            return pd.Series(out)

        return vectors.withColumn("cell", cell("vector"))

    def build(self, vectors: DataFrame, cells: int) -> int:
        """All vectors anew, in `cells` cells."""
        version, _ = self.manifests.newest()
        centres = fit_cells(vectors, min(cells, MOST_CELLS))
        schema = vectors.select("doc", "vector").schema
        return self._segment(version, {"centres": centres, "segments": [], "schema": schema.jsonValue()}, vectors)

    def add(self, vectors: DataFrame) -> int:
        """Further vectors; those whose doc is there already stay as they are."""
        version, state = self.manifests.newest()
        return self._segment(version, state, vectors.join(self.vectors().select("doc").distinct(), "doc", "left_anti"))

    def _segment(self, version: int, state: dict, vectors: DataFrame) -> int:
        segment = uuid.uuid4().hex
        rows = self._assigned(vectors.select("doc", "vector"), np.array(state["centres"]))
        rows.repartition("cell", F.pmod(F.xxhash64("doc"), F.lit(16))).write.partitionBy("cell").parquet(f"{self.path}/data/{segment}")
        return self.manifests.commit(version, state | {"segments": [*state["segments"], segment]})

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """doc, vector, cell, of some cells if these are given."""
        state = self._state()
        schema = StructType.fromJson(state["schema"]).add("cell", IntegerType())
        out = None
        for s in state["segments"]:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/data/{s}")
            out = part if out is None else out.unionByName(part)
        return out if cells is None else out.where(F.col("cell").isin(cells))

    def _placed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query, vector, cell: queries with each of their nearest cells."""
        centres = np.array(self._state()["centres"])
        unit = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        shared, most = self.spark.sparkContext.broadcast(unit), min(probes, len(unit))

        @F.pandas_udf("array<int>")
        def cells(vector: pd.Series) -> pd.Series:
            scores = np.stack(vector.to_numpy()).astype(np.float64) @ shared.value.T if len(vector) else np.zeros((0, len(shared.value)))
            return pd.Series(list(np.argpartition(-scores, most - 1, axis=1)[:, :most].astype(np.int32)))

        return queries.select("query", "vector", F.explode(cells("vector")).alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int = 8, digits: int | None = None) -> DataFrame:
        """query, doc, score, rank: the k best of the nearest cells, by exact cosine (digits: rounded to so many places before they are ranked); queries (query,
        vector) go in blocks of QUERY_BLOCK, each broadcast."""
        placed = self._placed(queries, probes)
        blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
        for b in range(blocks):
            block = placed if blocks == 1 else placed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
            cells = [r[0] for r in block.select("cell").distinct().collect()]  # at most MOST_CELLS
            best = top_k(nearest(self.vectors(cells), block, k, digits, cell=True), ["query"], k)
            out = best if out is None else out.unionByName(best)
        return out

    def read_share(self, queries: DataFrame, probes: int) -> float:
        """The share of all vectors that a search of these queries compares with, in the mean over the queries."""
        sizes = self.vectors().groupBy("cell").agg(F.count("*").alias("n"))
        found = self._placed(queries, probes).join(sizes, "cell").groupBy("query").agg(F.sum("n").alias("n")).agg(F.avg("n")).first()[0] or 0
        return found / max(1, sizes.agg(F.sum("n")).first()[0] or 0)

    def vacuum(self) -> int:
        return self.manifests.vacuum(set(self._state()["segments"]))


def recall(index: VectorIndex, vectors: DataFrame, queries: DataFrame, k: int, probes: int) -> float:
    """The share of the exact search's k best that the index finds."""
    exact = knn(vectors, queries, k).select("query", "doc")
    found = exact.join(index.search(queries, k, probes).select("query", "doc"), ["query", "doc"], "left_semi").count()
    return found / max(1, exact.count())
