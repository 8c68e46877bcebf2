"""Rating and forecasting of competitors from game results, on Spark DataFrames."""
