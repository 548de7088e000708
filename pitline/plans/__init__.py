"""End-to-end chains: filings to events, events to the model-ready table."""
