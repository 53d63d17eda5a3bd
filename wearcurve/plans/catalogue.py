"""All queries of the library and their SQL twins."""

from wearcurve.plans import curves, files, scores, summaries, texts
from wearcurve.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "curves", "files", "scores", "summaries", "texts"]
