"""Corpus linguistics and text analytics on Spark DataFrames."""
