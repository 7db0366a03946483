"""Readers of the file formats, and the sinks that write them."""
