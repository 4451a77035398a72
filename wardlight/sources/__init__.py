"""Readers with explicit schemas (batch and stream) and the sinks."""
