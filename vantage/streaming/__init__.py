"""Streaming counterparts of the registry and tally operators."""
