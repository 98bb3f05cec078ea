"""Readers, adapters, generators and sinks."""
