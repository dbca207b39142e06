"""Relational, ranking, selection and geometry operators."""
