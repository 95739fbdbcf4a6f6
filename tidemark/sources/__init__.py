"""Sources and sinks: device files, manifests, sessions and bundles."""

from .._lazy import exported

__getattr__, __all__ = exported(
    __name__,
    {
        "device_files": "DeviceFiles register",
        "readers": "timestamps_from_parquet samples_from_times topology_of limit_per_stream load_mapping save_mapping ReferenceConfig save_bundle load_bundle load_bundle_sessions drop_versions",
        "sessions": "CONTRACT_VERSION SCHEMA_VERSION Ingested ingest load_sessions save_sessions load_descriptors from_json to_json to_yaml violations descriptor_violations batch_violations registrations devices_of streams_of reference_device ground_truth to_rows to_batches",
        "typed": "type_faults",
    },
)
