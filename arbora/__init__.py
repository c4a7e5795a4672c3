"""Arbora: a Spark-native engine for querying structured hierarchies, Rust source code first."""
