"""tabspark: Spark-native tabular feature engineering, profiling, out-of-fold modelling and ensembling."""

__version__ = "0.1.0"
