"""sources of millrace."""
