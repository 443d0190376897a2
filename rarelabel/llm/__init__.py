"""Operators for training text: dedup, token counts, toxicity, packing, mixing, chat formats."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
