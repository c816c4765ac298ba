"""Spark-native analytics of what follows what in a network divided into zones."""
