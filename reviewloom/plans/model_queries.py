"""Evaluation of classifiers over ranked terms."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features as X
from ..operators.model import cross_validated
from ..operators.shared import written
from .registry import Tables, query
from .text_queries import classes

#: Numbers of terms.
TERM_COUNTS = [10, 25, 50, 75, 100, 125, 150, 175, 200, 225, 250, 275, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 850, 900, 950, 1000, 1100, 1200, 1300, 1400, 1500, 1600, 1700, 1800, 1900, 2000, 2095]


@query(None)
def cv_linear(t: Tables) -> DataFrame:
    """Ten folds of each number of terms, for the rankings by frequency and by chi-square."""
    weights = written(X.tfidf(t.documents, only=classes(t)), "weights")
    most = max(TERM_COUNTS)
    by_frequency = X.ranked(X.term_frequency(X.term_counts(t.documents)), "freq", most)
    by_chi2 = X.ranked(X.chi2(weights, classes(t)), "chi2", most)
    return cross_validated(weights, {"freq": by_frequency, "chi2": by_chi2}, classes(t), TERM_COUNTS)
