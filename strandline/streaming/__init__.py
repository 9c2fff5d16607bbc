"""Change streams: newest wins, and detection that follows them."""
