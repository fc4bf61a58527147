"""Relational, graph and scoring operators over DataFrames."""
