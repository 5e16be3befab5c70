"""Streaming analogues: the log's state as a running query."""
