"""Training-data operators tagged llm, and their queries."""
