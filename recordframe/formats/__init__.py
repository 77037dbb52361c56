"""Decoders: pure functions from the bytes of one file to Arrow columns, without Spark."""
