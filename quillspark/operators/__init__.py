"""Relational, panel, entity, rule and estimation operators on DataFrames."""
