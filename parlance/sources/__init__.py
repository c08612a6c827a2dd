"""Readers and writers of session files."""
