"""Spark-native inspection, mitigation and curation of untrusted text."""
