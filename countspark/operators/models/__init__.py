"""Models trained from counts. Parameters are small tables; scoring is Column expressions, without shuffles or Python workers."""
