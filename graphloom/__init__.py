"""A Spark-native engine that turns documents and vectors into a weighted concept graph and reasons over it."""
