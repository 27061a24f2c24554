"""Stateful online detection."""
