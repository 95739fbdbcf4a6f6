"""Streams: running fits, bursts, association and as-of joins."""

from .._lazy import exported

__getattr__, __all__ = exported(
    __name__,
    {
        "online": "online_fit bursts",
        "stateful": "associate_stream asof_join_stream use_rocksdb",
    },
)
