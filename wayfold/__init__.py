"""wayfold: motion telemetry, map matching and report queries on Spark DataFrames."""
