"""Readers, writers and record normalisers."""
