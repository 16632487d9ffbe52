"""affinity: recommendation analytics as DataFrame jobs.

Events become preferences, preferences become models, and every request
(predict, recommend, similar) is a DataFrame in and a DataFrame out.
"""

from affinity import functions, operators, plans, sources, streaming
from affinity.schemas import (
    CONTEXT_PREF, EVENT, LAYOUT, POINT, PREF, RULE, SIMILAR_COLUMNS,
    SIMILAR_FIELDS, USER_RULES,
)

__all__ = [
    "functions", "operators", "plans", "sources", "streaming",
    "CONTEXT_PREF", "EVENT", "LAYOUT", "POINT", "PREF", "RULE",
    "SIMILAR_COLUMNS", "SIMILAR_FIELDS", "USER_RULES",
]
