"""Operators over box and line relations."""
