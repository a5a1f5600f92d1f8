"""Distributed plan building blocks."""
