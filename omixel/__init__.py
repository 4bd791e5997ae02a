"""omixel: a Spark-native engine for sparse sample x feature analytics."""
