"""rankaudit: learning-to-rank features, pairwise training, exposure fairness
and re-ranking, expressed as Spark DataFrame jobs."""

__version__ = "0.1.0"
