"""Palimpsest: analytics over evolving data, as Spark plans."""
