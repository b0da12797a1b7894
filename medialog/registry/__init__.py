"""Every registered query; importing this package fills REGISTRY."""

from medialog.registry.core import REGISTRY
from medialog.registry import access, activity, catalogue, day_grain, documents, publishing, streams  # noqa: F401

__all__ = ["REGISTRY"]
