"""Spark-native analytics over text corpora, user events and daily schedules."""
