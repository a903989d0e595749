"""Where collections are and what they are made from."""
