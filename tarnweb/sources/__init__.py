"""Input tables and output forms."""
