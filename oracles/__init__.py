"""Check SQL per registered query."""

from . import scores, search, text

ORACLES: dict[str, str] = {**text.SQL, **scores.SQL, **search.SQL}
