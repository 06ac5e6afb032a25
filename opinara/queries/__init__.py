"""Named queries over the given tables, each with the SQL that checks it where SQL can express it."""

from importlib import import_module

MODULES = (
    "sources", "shaping", "filters", "aggregates", "order", "scalars", "polarity", "features", "models", "metrics", "stream", "collection",
)


def load_all() -> None:
    for name in MODULES:
        import_module(f"opinara.queries.{name}")
