"""Docket: order-document analytics on Spark DataFrames."""
