"""Dialect text analytics and corpus engineering as Spark plans."""
