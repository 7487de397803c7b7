"""A Spark-native engine that finds how technology topics emerge and evolve in a corpus of papers."""
