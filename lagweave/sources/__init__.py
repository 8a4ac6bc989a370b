"""Readers and writers at the text boundary."""
