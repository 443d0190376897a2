"""Chi-square selection as a pipeline stage, fitted on training rows only."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.sql import DataFrame

from ..functions.features import Features, vector_width
from ..operators.chisq import chi_square_scores, rank_features, selected_positions


class TopChiSquare(Estimator, HasFeaturesCol, HasLabelCol, HasOutputCol):
    """Keeps the ``k`` positions with the largest chi-square statistic.

    Fitting gives a ``VectorSlicer``, so fitted pipelines can be stored.  As a
    stage it sees the training side of each fold alone, and ``k`` can be tuned.
    """

    k = Param(Params._dummy(), "k", "number of positions to keep", TypeConverters.toInt)
    rankBy = Param(Params._dummy(), "rankBy", "statistic or p_value", TypeConverters.toString)

    @keyword_only
    def __init__(
        self, *, k=5, rankBy="statistic", featuresCol="features", labelCol="label", outputCol="selected"
    ):
        super().__init__()
        self._setDefault(k=5, rankBy="statistic", outputCol="selected")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> VectorSlicer:
        source = self.getFeaturesCol()
        features = Features.of_vector(source, vector_width(dataset, source))
        ranked = rank_features(
            chi_square_scores(dataset, features, self.getLabelCol()), self.getOrDefault(self.rankBy)
        )
        keep = selected_positions(ranked, min(self.getOrDefault(self.k), features.width))
        return VectorSlicer(inputCol=source, outputCol=self.getOutputCol(), indices=keep)
