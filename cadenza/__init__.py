"""Spark-first engine for sequence features, mixture and chain models, speaker counting and diary queries."""
