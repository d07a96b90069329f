"""Braidwork: a Spark-native engine for integrating inconsistent tabular sources."""
