"""Panel forecasting on Spark: DataFrame-in, DataFrame-out building blocks."""

__version__ = "0.1.0"
