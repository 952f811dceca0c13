"""Operators over tables of blocks, spans, boxes and items."""
