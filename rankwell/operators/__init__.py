"""Index and lookup operators over DataFrames."""
