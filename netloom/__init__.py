"""netloom: property-graph analytics for network traffic on Spark DataFrames."""
