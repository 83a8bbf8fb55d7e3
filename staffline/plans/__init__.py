"""Composite plans (bundles of operators over one prepared staff table) and plan checks."""
