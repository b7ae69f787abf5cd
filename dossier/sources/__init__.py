"""Reading packages and reference lists, and writing results."""
