"""Registered queries over the test tables."""


def load_all() -> None:
    """Import every query module so that its queries are registered."""
    from . import logistics, roads, spatial, tables  # noqa: F401
