"""Readers with explicit schemas, writers and run history."""
