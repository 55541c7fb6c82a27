"""Streams: file events into refreshes, by trigger policies, and the append-only event log."""
