"""quillon: index-driven analytics and corpus preparation on Spark DataFrames."""
