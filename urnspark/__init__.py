"""Temporal draw analytics and corpus preparation as Spark DataFrame programs."""
