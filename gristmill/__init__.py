"""A Spark-first engine for job-posting data: ingest, dedup, search, matching and trust as DataFrame operators."""
