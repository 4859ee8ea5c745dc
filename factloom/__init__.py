"""factloom: repository-fact analytics expressed as Spark DataFrames."""
