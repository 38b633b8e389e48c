"""Readers, file selection and writers."""
