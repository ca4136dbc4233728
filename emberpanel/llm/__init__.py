"""Corpus operators for language-model training data, each on Spark DataFrames.

Nothing outside this subpackage imports it; ``queries.QUERIES`` lists what ``__spark_entry__`` registers.
"""
