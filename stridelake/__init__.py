"""Training-load and sensor-stream analytics on Spark DataFrames."""
