"""Readers and writers: source trees, version control, configuration, snapshots."""
