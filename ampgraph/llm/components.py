"""Connected components of a link table: the core's."""

from ..operators.components import connected_components

__all__ = ["connected_components"]
