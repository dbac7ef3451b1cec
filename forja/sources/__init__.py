"""Readers, conforming steps and writers."""
