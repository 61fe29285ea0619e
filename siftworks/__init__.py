"""Spark-first cleaning, analysis and incremental loading of self-reported records."""
