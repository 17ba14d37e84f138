"""Readers, writers and session settings."""
