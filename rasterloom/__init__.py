"""rasterloom: gridded and sampled geospatial analytics as Spark DataFrames."""
