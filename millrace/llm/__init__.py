"""Operators of a large-scale training-data pipeline; nothing outside this package imports it.

Each module holds one operator as functions on DataFrames; ``queries`` applies
them to the given tables. The heavy work runs in ``mapInArrow`` tasks on Arrow
batches, and Spark partitions and shuffles it.
"""
