"""Part of fitlake."""
