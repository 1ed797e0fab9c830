"""Streaming forms of the batch operators (an extension: the batch operators define the results)."""
