"""Spark-native engine for evidence-grounded retrieval, property graphs and corpus preparation."""
