"""Employer-risk analytics as plain functions of Spark DataFrames."""

__version__ = "0.1.0"
