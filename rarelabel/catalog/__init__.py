from . import (  # noqa: F401  (importing registers the queries)
    bayes_queries,
    encode_queries,
    evaluation_queries,
    learner_queries,
    sampling_queries,
    selection_queries,
    source_queries,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
