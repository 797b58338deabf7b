"""millrace: tables, dense arrays and statistical learning on Spark DataFrames."""
