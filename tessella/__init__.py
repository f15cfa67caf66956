"""tessella: concept-feature association and corpus analytics on Spark DataFrames."""
