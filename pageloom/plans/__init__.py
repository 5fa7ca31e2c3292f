"""Composite jobs and the wiring of the registered queries."""
