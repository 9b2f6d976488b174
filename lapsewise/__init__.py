"""Subscription retention and lifetime value on Spark DataFrames."""
