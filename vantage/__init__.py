"""Spark-native line-of-sight, registry and corpus analytics.

Every operator takes DataFrames and returns DataFrames; Spark plans, partitions
and shuffles the work.
"""
