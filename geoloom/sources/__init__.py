"""Readers, writers and encoders."""
