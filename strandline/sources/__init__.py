"""Readers, scanners, parsers and writers."""
