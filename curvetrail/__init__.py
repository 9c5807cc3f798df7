"""Spark-native analytics for object trajectories and score curves."""
