"""Tables that arrive in batches."""
