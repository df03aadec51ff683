"""Report definitions and multi-source runs."""
