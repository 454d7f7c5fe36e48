"""Pipeline stages that make a saved model complete: engineered features and
population scaling as ML transformers, stored with the classifier, so that a
loaded model takes raw readings."""

from __future__ import annotations

from typing import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import engineer_features


class FeatureStep(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Appends the 32 engineered features to readings; columns of their names
    that the rows bring along are replaced."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from ..functions.features import ENGINEERED_FEATURES

        return engineer_features(dataset.drop(*ENGINEERED_FEATURES))


class ScaleStep(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted population scaling of the input columns into one vector; the
    columns themselves stay as they are."""

    means = Param(Params._dummy(), "means", "mean of each input column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population standard deviation of each (0 scales by 1)", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCol: str | None = None,
                 means: Sequence[float] | None = None, stds: Sequence[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scaled = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s if s else 1.0) for c, m, s in
                  zip(self.getInputCols(), self.getOrDefault(self.means), self.getOrDefault(self.stds))]
        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*scaled)))
