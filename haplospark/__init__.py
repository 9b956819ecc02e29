"""A Spark-native engine that evaluates phased genomic variant calls."""
