"""Plans: the whole query."""

from .._lazy import exported

__getattr__, __all__ = exported(
    __name__,
    {
        "engine": "Result TIERS rated_devices select_reference synchronize",
    },
)
