"""Analytics over collections of prompt and Markdown documents, on Spark."""
