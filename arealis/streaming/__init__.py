"""Delivery of result rows one at a time."""

from arealis.streaming.delivery import stream_json

__all__ = ["stream_json"]
