"""foliant: a Spark-native engine for catalogue, review and tag corpora."""
