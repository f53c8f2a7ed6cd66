"""Tutoring-conversation analytics on Spark."""
