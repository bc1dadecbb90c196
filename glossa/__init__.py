"""A static string dictionary on Spark: dense deterministic ids, prefix and predictive search over DataFrames."""
