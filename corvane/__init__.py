"""Corvane: knowledge-data pipelines and registry analytics on Spark DataFrames."""
