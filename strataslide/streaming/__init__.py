"""Requests as a stream."""

from .requests import request_counts, requests_stream, tiles_for_requests

__all__ = ["request_counts", "requests_stream", "tiles_for_requests"]
