"""Brute-force versions that several tests share."""

from test_linededup import brute
from test_simhash import naive_components, naive_fingerprint

brute_components, spans_by_hand = naive_components, brute
__all__ = ["brute_components", "naive_fingerprint", "spans_by_hand"]
