"""Domain plans: DataFrames in, one DataFrame out."""
