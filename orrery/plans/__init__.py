"""Adapter views and named queries."""
