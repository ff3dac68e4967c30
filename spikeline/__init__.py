"""Spark-native event-study analytics over entity x time panels."""
