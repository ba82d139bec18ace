"""Relational post-processing of model-written proposals, routing and export."""
