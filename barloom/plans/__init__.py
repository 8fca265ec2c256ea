"""What a set of requests needs done, and the driver that does it."""
