"""Tables to read and formats to read and write them in."""
