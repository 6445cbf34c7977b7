"""Operators for preparing language-model training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; Python runs only inside Arrow batches that Spark partitions.
"""
