"""pairloom: a Spark-native engine for preparing, training and judging text embeddings."""
