"""Point-in-time event-study operators on Spark DataFrames."""
