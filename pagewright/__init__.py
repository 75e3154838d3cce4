"""Spark-first page triage and question-deck analytics."""
