"""rookery: a Spark-native engine for short social posts and the graphs they imply."""
