"""Longitudinal trajectory analytics on Spark DataFrames."""

from trajspark.params import Params

__all__ = ["Params"]
