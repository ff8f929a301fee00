"""Readers and writers with explicit schemas, and small atomic exports."""
