"""Readers and writers: tables, source trees, project configuration."""
