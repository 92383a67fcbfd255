"""Innovation-panel analytics and corpus preparation, written directly on Spark DataFrames."""
