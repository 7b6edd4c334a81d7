"""Readers and writers: source trees, archives, commit logs, graph snapshots, text exports."""
