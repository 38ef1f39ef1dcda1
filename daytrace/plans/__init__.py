"""Named queries by area; ``load_all`` fills the registry."""

from importlib import import_module

AREAS = ["activity", "vectors", "reports", "texts", "evaluation", "stages", "scans"]


def load_all() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")
