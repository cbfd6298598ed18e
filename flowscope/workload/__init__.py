"""Registered queries and their SQL twins over the benchmark tables."""
