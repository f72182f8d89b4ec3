"""A PySpark-native engine for document retrieval, retrieval analytics and governance queries."""
