"""Whole jobs: ranked search and the service's own queries."""
