"""Strict scans, file checks and write-once sinks."""
