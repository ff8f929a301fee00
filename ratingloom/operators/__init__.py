"""Relational, sequential, modelling and simulation operators over DataFrames."""
