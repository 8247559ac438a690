"""Spark-native analytics over dyadic panels, dispute networks and case documents."""
