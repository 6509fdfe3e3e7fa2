"""Price tables in, model tables in and out."""
