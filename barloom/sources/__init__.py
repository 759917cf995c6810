"""Readers and writers: bar files, tick tables, watchlists."""
