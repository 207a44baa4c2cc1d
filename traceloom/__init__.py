"""Spark-native analytics over step histories: records, content-addressed values, events and span trees."""
