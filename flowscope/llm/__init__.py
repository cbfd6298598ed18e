"""Operators for large text corpora: identify, deduplicate, decontaminate, pseudonymise, score, shard, archive, encode."""
