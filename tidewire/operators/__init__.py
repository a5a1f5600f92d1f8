"""DataFrame-to-DataFrame operators on message feeds."""
