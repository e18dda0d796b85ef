"""End-to-end studies, each re-aimed at the fixture tables."""

from . import maps, people, shares, text, trade, votes  # noqa: F401
