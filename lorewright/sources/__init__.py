"""Part of the library: sources."""
