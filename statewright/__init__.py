"""Spark-native analytics over cluster-coordination data: logs, state, metrics, placement, workflows."""
