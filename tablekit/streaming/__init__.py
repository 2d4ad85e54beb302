"""Checks of streams."""
