"""Operators over events and visits."""
