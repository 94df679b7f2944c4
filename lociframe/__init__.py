"""Spark-native interval, graph, sequence and corpus analytics on DataFrames."""
