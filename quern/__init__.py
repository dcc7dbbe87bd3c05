"""A typed, deterministic analytics engine over Spark DataFrames."""
