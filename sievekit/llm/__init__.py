"""Operators for large-scale training-data preparation.

One module per operator; nothing else in the library imports this package.
``registry`` holds the driver queries and their DuckDB SQL.
"""
