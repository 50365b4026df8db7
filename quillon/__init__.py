"""Spark-native analytics for error-bounded numeric data and the corpora around it."""
