"""Part of unitweave."""
