"""Spark-native analytics over provenance-tracked bibliographic stores."""
