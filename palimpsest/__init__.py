"""palimpsest: literature-retrieval quality work and corpus preparation on Spark DataFrames."""
