"""Web and product analytics as plain DataFrame jobs."""
