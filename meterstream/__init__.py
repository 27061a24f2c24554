"""PySpark-native engine for cumulative-meter time series and corpus preparation."""
