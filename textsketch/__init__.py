"""Text indexing, similarity and placement operators for PySpark DataFrames."""
