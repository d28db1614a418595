"""Subscriber churn and lifetime-value analytics on Spark."""
