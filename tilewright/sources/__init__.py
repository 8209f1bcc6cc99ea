"""Readers, writers and serialised annotation formats."""
