"""Panel analytics for daily bars and point-in-time events, on Spark DataFrames."""
