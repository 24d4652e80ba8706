"""promptbook: Spark-first analytics over speaker-attributed text."""
