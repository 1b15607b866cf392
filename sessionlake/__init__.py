"""Spark-native analytics over conversation and agent-activity logs."""
