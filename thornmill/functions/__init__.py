"""Scalar and aggregate functions that Spark lacks or reads otherwise, as SQL expressions; Python only where JSON is edited."""
