"""docloom: Spark-native dataflow for documentation workflows."""
