"""A PySpark-native analytics engine for knowledge-graph triples."""
