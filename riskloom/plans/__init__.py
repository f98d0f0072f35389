"""Registered queries: each a DataFrame job over the driver tables, with SQL of the same result where it exists."""
