"""tapestride: a Spark-first engine for entity linking, text statistics and corpus preparation."""
