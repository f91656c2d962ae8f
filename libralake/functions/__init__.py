"""Part of libralake."""
