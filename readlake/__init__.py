"""readlake: long-read sequencing tables as Spark DataFrames."""
