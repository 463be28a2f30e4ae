"""A PySpark-native engine for curating and evaluating typed-decision datasets."""
