"""Readers and writers of activity logs, and the collector."""
