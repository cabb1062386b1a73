"""pairloom: near-duplicate record, pair and cluster analytics on Spark DataFrames."""
