"""Tiered retrieval and memory analytics as functions from DataFrame to DataFrame."""
