"""Part of strata."""
