"""Clock reconciliation of timestamped streams on Spark. The names below are the usual way in; they are loaded when asked for."""

from importlib import import_module

_PLACES = {
    "Gates": ".operators.metrics",
    "Result": ".plans.engine",
    "select_reference": ".plans.engine",
    "synchronize": ".plans.engine",
    "ReferenceConfig": ".sources.readers",
    "load_bundle": ".sources.readers",
    "save_bundle": ".sources.readers",
    "CONTRACT_VERSION": ".sources.sessions",
    "SCHEMA_VERSION": ".sources.sessions",
    "Ingested": ".sources.sessions",
    "ingest": ".sources.sessions",
    "load_descriptors": ".sources.sessions",
    "load_sessions": ".sources.sessions",
    "save_sessions": ".sources.sessions",
    "violations": ".sources.sessions",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(_PLACES[name], __name__), name)
