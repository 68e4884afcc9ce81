"""operators of millrace."""
