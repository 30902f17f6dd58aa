"""Readers with explicit schemas, and writers that never leave half a result behind."""
