"""Tarn: a Spark-native live document index and corpus engine."""
