"""Scans, inventories, artifact readers and writers."""
