"""Readers that turn shop payloads and logs into tables."""
