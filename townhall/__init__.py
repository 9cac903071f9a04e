"""Civic records and local news on Spark."""
