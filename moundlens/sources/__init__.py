"""Reading and writing the pitch log."""
