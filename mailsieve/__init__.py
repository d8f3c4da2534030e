"""E-mail threat scoring as Spark DataFrame and Structured Streaming jobs."""
