"""Readers and writers for handshake records, intelligence snapshots, feature tables and models."""
