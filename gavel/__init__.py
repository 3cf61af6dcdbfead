"""Data governance on Spark: normalise, score, decide, record and report."""
