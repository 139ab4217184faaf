"""The layout of vectors (V7) as a stage: fitted on one table, with places for the rows of any other."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.descent import knn_descent
from lexiloom.operators.layout import EPOCHS, knn_between, layout, place_new
from lexiloom.operators.neighbours import fuzzy_union, fuzzy_weights
from lexiloom.session import scratch_path


def _distinct(df: DataFrame, vector: str) -> DataFrame:
    """``id, v``: every vector once, under a hash of its entries."""
    v = vector_to_array(F.col(vector))
    rows = df.where(F.col(vector).isNotNull()).select(v.alias("v"))
    return rows.select(F.xxhash64("v").alias("id"), "v").dropDuplicates(["id"])


class Places(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the place of each vector: the weighted mean of its neighbours' places in the table at ``path``.

    A vector of the fitted table has its own place, and a null one none. The table belongs to the model.
    """

    path = Param(Params._dummy(), "path", "id, v, coords of the fitted rows", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "the vector column", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the places", TypeConverters.toString)
    components = Param(Params._dummy(), "components", "dimensions of a place", TypeConverters.toInt)
    neighbours = Param(Params._dummy(), "neighbours", "neighbours that place a row", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, path: str = "", inputCol: str = "", outputCol: str = "", components: int = 2, neighbours: int = 15):  # noqa: N803
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        source, size = self.getOrDefault(self.inputCol), self.getOrDefault(self.components)
        known = dataset.sparkSession.read.parquet(self.getOrDefault(self.path))
        near = knn_between(_distinct(dataset, source), known, "id", "v", self.getOrDefault(self.neighbours))
        places = place_new(near, known.select("id", "coords"), "id", size).select(F.col("id").alias("_place"), "coords")
        rows = dataset.withColumn("_place", F.when(F.col(source).isNotNull(), F.xxhash64(vector_to_array(F.col(source)))))
        put = rows.join(places, "_place", "left")
        return put.withColumn(self.getOrDefault(self.outputCol), array_to_vector("coords")).drop("_place", "coords")


def fit_places(
    train: DataFrame, vector: str, output: str, components: int = 2, neighbours: int = 15, epochs: int = EPOCHS, path: str | None = None
) -> Places:
    """Lay out the distinct vectors of a table. ``path`` keeps the places beyond the shared folder's life."""
    path = path or scratch_path(train.sparkSession, "places")
    rows = _distinct(train, vector)
    edges = fuzzy_union(fuzzy_weights(knn_descent(rows, "id", "v", neighbours), "id"), "id")
    layout(edges, components, epochs).join(rows, "id").write.parquet(path)
    return Places(path=path, inputCol=vector, outputCol=output, components=components, neighbours=neighbours)
