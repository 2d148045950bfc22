"""A Spark-native engine for relational, full-text, vector and hybrid queries."""
