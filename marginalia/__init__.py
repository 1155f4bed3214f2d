"""Batch and streaming jobs for document question answering on Spark."""
