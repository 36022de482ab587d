"""Spark-native terrain and drainage analytics."""
