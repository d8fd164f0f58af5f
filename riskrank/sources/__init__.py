"""Readers, writers and the adapter that derives raw inputs from order tables."""
