"""A PySpark-native analytics engine with the semantics of a dynamically typed embedded SQL database."""
