"""Arrays from host memory and tables, and back."""
