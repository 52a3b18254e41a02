"""Flows of versioned operators, lowered to Spark DataFrames: one row is one run, one node is one column."""
