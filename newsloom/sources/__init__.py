"""Readers and writers for feed files, configuration, payloads and the article table."""
