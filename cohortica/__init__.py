"""cohortica: survival analytics over loan-month style panels, expressed on Spark DataFrames."""

__version__ = "0.1.0"
