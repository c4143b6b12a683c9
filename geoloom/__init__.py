"""geoloom: geodata analytics on Spark DataFrames."""
