"""Column functions: text preparation, answer judging and scheduling arithmetic."""
