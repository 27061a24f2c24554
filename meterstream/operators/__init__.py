"""Relational and grouped operators on meter readings."""
