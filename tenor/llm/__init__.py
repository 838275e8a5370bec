"""Operators for large-scale training-data preparation.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` holds the registered queries and their DuckDB SQL.
"""
