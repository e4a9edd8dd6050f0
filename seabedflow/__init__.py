"""Spark-native gridding of sonar soundings into depth and uncertainty surfaces."""
