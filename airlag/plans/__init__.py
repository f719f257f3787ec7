"""Pipelines, estimators and the query catalog."""
