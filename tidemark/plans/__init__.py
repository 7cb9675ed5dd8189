"""Queries: plans over a data folder, each beside the SQL it must agree with."""
