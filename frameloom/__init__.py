"""frameloom: a Spark-native engine for preparing unlabelled image and frame collections."""

__version__ = "0.1.0"
