"""Readers: landed provider responses, graph files, lists and logs. Nothing here talks to a network."""
