from affinity.sources.readers import (
    map_columns, parse_points, read_context_preferences, read_events, read_points, read_preferences,
)
from affinity.sources.writers import write_context_preferences, write_points, write_preferences

__all__ = [
    "map_columns", "parse_points", "read_context_preferences", "read_events", "read_points",
    "read_preferences", "write_context_preferences", "write_points", "write_preferences",
]
