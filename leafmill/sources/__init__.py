"""Where documents and boxes come from."""
