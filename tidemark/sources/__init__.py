"""Readers and writers of the reference formats."""
