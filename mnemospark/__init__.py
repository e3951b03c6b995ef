"""Long-term agent memory as Spark DataFrames.

Every operation is a function from DataFrames to DataFrames that serves all
users at once and takes its reference time as an argument.
"""
