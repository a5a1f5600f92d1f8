"""Streaming operators: the batch operators per micro-batch, with state kept in tables."""
