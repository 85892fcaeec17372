"""pixelseries: satellite pixel time series as Spark DataFrames."""
