"""A PySpark-native analytics engine: DataFrame operators planned by Catalyst."""
