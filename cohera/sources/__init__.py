"""Readers that turn outside formats into the bundle tables, and the sinks that write them."""
