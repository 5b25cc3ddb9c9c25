"""Lodeworks: source-code analytics and retrieval as ordinary Spark plans."""
