"""Marine spill analytics on Spark."""
