"""A Spark-native engine to index, search, audit and curate document collections."""
