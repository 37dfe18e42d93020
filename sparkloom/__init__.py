"""A Spark-native engine for statistical analysis and data preparation."""
