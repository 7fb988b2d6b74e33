"""Query languages compiled to DataFrames."""
