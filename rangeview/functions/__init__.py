"""Part of rangeview."""
