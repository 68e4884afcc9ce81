"""streaming of millrace."""
