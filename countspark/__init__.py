"""countspark: count-driven statistical learning and corpus operators on Spark DataFrames."""
