"""Lyric-timing and service-log jobs for Apache Spark."""
