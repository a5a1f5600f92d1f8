"""Readers: spools, snapshots, file trees, logs and pages."""
