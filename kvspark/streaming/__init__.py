"""Logs as streams."""
