"""Spark-native chain ETL and fraud-ring analytics.

Every operator takes DataFrames and returns DataFrames; nothing is executed until
the caller runs an action, apart from the convergence tests of the iterative graph
operators.
"""
