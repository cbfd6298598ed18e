"""Pairing of handshake streams."""
