"""End-to-end programs and the registered table queries."""
