"""gradeloom: evaluation analytics over question/answer/judgement tables, on Spark DataFrames."""

__version__ = "0.1.0"
