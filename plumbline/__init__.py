"""Plumbline: facts as tables, rules as plans, on Spark DataFrames."""
