"""Batch and streaming jobs for commercial catalogue and quotation data on Spark."""
