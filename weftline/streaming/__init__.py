"""Structured Streaming counterparts of the iterative operators."""

from weftline.streaming.update import latest_by_key, tumbling_counts, update_stream

__all__ = ["latest_by_key", "tumbling_counts", "update_stream"]
