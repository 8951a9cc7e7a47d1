"""A Spark-native engine for building and analysing knowledge-graph triples."""
