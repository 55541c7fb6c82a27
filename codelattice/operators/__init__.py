"""Logical operators as DataFrame functions."""
