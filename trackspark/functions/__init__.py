"""See README.md for the operator map."""
