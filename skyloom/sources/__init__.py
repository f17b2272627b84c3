"""Catalogue readers, generators and sinks."""
