"""Query catalogue and text exports."""

from . import asking, cards, details, grouping, live, naming, streams  # noqa: F401  they register their queries in the catalogue
