"""Key-sentence extraction and data processing on Spark DataFrames."""
