"""Physical helpers: shared scratch storage, skew-proof joins."""
