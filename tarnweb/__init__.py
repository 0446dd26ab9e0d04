"""tarnweb: site-audit analytics and corpus processing on Spark DataFrames."""
