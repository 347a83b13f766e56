"""Spatial and tabular analytics as DataFrame functions."""
