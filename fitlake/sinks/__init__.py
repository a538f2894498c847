"""Writers of files and texts."""
