"""Log analytics on Spark DataFrames: collapse, exclude, budget, pack, request, classify, keep."""
