"""Readers, writers and shared-folder helpers."""
