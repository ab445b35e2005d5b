"""lodestrata: code- and text-corpus analytics as Spark DataFrames."""
