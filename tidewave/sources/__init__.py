"""Readers that expose recording formats as Spark data sources."""
