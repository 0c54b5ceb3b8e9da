"""A small HTTP service that computes expressions sent as trees, and its client."""
