"""Pipelines over files as they arrive."""

from .stream import append_stream, stream_frame

__all__ = ["append_stream", "stream_frame"]
