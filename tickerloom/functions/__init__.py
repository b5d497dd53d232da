"""Column helpers: text, numbers, dates, model replies."""
