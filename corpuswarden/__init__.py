"""Corpus audit on Spark: structure extraction, rules, findings and policy."""
