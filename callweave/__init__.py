"""Call-graph analytics on Spark: nodes, edges and labels as DataFrames, queries as plans over them."""
