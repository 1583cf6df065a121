"""A PySpark-native engine that builds, queries, completes and scores knowledge graphs."""
