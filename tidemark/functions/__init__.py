"""Scalar functions over columns."""

from .._lazy import exported

__getattr__, __all__ = exported(
    __name__,
    {
        "scalars": "register_scheme allowed_schemes parse_uri is_payload_uri build_uri semver contract_version_supported",
    },
)
