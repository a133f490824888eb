"""A PySpark-native analytics engine for study centres and libraries."""
