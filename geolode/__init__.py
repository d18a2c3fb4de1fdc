"""Point-cloud analytics on Spark DataFrames, for very large tiled LiDAR data."""
