"""Relational operators of the audit engine, generic over tables and keys."""
