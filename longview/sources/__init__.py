"""Readers and writers of tables, lagged frames and models."""
