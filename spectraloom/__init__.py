"""Spark-native analytics engine for proteomics search, inference and general relational operators."""
