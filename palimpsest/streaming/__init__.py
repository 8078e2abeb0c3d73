"""Structured Streaming facade: the batch operators over unbounded inputs."""
