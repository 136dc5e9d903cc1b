"""Training-data operators: ten corpus operations, each a function from DataFrames to a DataFrame."""
