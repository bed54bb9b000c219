"""Page-text analytics on Spark: page outcomes, geometry, rasters, reply protocols and run logs as DataFrames."""
