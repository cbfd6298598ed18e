"""Detectors and feature reduction fitted on Spark."""
