"""Text analytics and retrieval over DataFrames."""
