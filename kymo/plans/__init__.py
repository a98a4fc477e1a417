"""Composite plans: one row per subject and day, for all subjects in one job."""
