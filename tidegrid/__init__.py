"""Market time series and scored text, analysed with Spark DataFrames."""
