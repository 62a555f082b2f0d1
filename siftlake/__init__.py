"""Spark-native analytics over repository-security findings, scan logs, import graphs and text corpora."""
