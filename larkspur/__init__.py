"""larkspur: a PySpark-native engine for price-ladder time series and training-data pipelines."""
