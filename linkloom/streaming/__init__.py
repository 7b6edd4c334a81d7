"""Structured Streaming: windowed churn, incremental refresh, debounce, sliding limits."""
