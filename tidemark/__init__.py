"""tidemark: a Spark-native document-to-decision analytics engine."""
