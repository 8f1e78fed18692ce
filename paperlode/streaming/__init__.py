"""Structured Streaming jobs with durable state tables."""
