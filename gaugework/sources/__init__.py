"""Readers, derived inputs and writers."""
