"""Part of hushql."""
