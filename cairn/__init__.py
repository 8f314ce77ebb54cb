"""A Spark-native engine for analysing code indexes and the texts around them."""
