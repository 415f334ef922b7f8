"""Measures what tool interfaces cost a language-model agent, as Spark DataFrames."""
