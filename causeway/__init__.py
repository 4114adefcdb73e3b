"""Spark-native analytics over append-only causal event ledgers and oversight records."""
