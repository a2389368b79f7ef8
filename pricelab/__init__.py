"""Spark-native engine for price histories, headline corpora and forecast evaluation."""
