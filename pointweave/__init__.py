"""Point clouds, trajectories and registration on Spark DataFrames."""
