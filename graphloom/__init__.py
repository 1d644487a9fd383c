"""Graphloom: property-graph analytics and search on Spark DataFrames."""
