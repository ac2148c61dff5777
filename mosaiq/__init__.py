"""A Spark-native engine for evaluation analytics of multi-camera video question answering."""
