"""Content analytics on Spark: landing, de-duplication, scoring, ranking, search, reports and streams.

Every operator is a function from DataFrames (and small plain arguments) to a DataFrame.
"""
