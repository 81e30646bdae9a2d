"""recurra: historical-analogue search and event studies over bar tables, on Spark DataFrames."""
