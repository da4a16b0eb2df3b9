"""Registered queries over surveys and over plain tables."""
