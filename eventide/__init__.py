"""eventide: Spark-first analytics over longitudinal event tables."""
