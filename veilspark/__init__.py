"""Sensitive-data scanning, pseudonymisation and compliance analytics on Spark."""
