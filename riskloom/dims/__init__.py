"""Fixed value tables and small dimensions."""
