"""Bindings of the driver tables to claim shapes, and the SQL each query is checked against."""
