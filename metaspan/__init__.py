"""Spark-native data profiling, metadata discovery and lineage engine."""
