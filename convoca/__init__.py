"""Bilingual event search over Spark DataFrames."""
