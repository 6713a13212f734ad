"""Data-processing operators over DataFrames."""
