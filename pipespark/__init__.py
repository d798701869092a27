"""pipespark: declarative pipelines compiled to lazy Spark DataFrames."""
