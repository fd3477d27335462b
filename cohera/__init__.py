"""A Spark-native engine that measures how coherent a dataset is as a knowledge graph."""
