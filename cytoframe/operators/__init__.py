"""Analysis operators over DataFrames."""
