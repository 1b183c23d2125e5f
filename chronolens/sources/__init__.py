"""Readers, adapters and the event store."""
