"""Set-at-a-time retrieval, knowledge-graph and text analytics on Spark DataFrames."""
