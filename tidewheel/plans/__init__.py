"""From specifications to lazy DataFrames."""
