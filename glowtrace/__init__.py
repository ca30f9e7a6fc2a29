"""Analytics of time-resolved imaging recordings and their signals, as Spark DataFrames."""
