"""DataFrame → DataFrame operators with exact missing-value rules."""
