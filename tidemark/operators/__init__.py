"""Operators: functions from DataFrames to DataFrames, over all sessions at once."""

from .._lazy import exported

__getattr__, __all__ = exported(
    __name__,
    {
        "associate": "match_by_order observers unmatchable",
        "confidence": "build_confidence nearest_event_us",
        "detect": "find_peaks register_detector registered_detectors get_detector",
        "fit": "fit_piecewise rate_piecewise as_models ransac weighted_moments",
        "graph": "pair_observations build_edges reconcile",
        "metrics": "Gates gate dropout property_checks reconciliation_residual roundtrip_accuracy sync_method worst_device",
        "ordered": "numbered previous",
        "timeline": "asof_join asof_join_rated coverage grid slots_per_frame stream_positions subframe_buckets summary HOLD CONTINUOUS",
        "transforms": "compose invert correct_streams enforce_monotonic stream_key clock_confidence to_reference",
        "validate": "sample_violations monotonic_violations event_violations model_violations device_violations stream_violations session_violations",
    },
)
