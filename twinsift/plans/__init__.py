"""Removal plans: guards, dry runs and what remains afterwards."""
