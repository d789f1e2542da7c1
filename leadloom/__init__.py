"""Spark-native operators for business records, market demand and outreach planning."""
