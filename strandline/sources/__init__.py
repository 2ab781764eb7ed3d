"""Readers and writers: prepared document sets, records, artifacts, caches."""
