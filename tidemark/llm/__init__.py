"""Operators for training-data pipelines over ``documents``, ``pages``, ``benchmark`` and ``conversations``."""
