"""Structured Streaming forms of the flow operators; on the same input they give what the batch forms give."""
