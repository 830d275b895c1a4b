"""Gradient-boosted trees and relational training operators on Spark DataFrames."""

__version__ = "0.1.0"
