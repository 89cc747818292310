"""Shared logical plans: scoping, latest revisions, the joined plan, sizing and skew."""
