"""A Spark-native engine for embedding retrieval and occurrence curation."""
