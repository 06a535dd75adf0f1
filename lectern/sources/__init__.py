"""Readers, validators and parsers of inputs."""
