"""A Spark-native analytics engine for packed binary asset collections."""
