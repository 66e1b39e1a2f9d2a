"""Typed scans, contract checks and sinks."""
