"""Spark-native product-image retrieval, evaluation and catalogue data processing."""
