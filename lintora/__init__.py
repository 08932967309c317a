"""Secure-coding analytics as Spark DataFrame transformations."""
