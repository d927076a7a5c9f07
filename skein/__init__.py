"""A Spark-native relational query engine with a compact clause language."""
