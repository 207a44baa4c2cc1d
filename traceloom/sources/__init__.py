"""Readers and writers of histories."""
