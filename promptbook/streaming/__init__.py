"""Structured Streaming over tables that load late. An extension: the batch pipeline has no counterpart."""
