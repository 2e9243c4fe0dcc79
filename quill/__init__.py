"""quill: a Spark-native engine for vector-graphics documents (paths, groups, hierarchies)."""
