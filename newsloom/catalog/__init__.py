"""All named queries; importing this package registers them."""

from . import documents, graph, pages, search, streams, text, upkeep, urls, vectors  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
