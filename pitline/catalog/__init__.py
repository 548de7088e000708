"""Ready-made queries over the test tables, each with its SQL oracle."""

from importlib import import_module

MODULES = ["market", "filings", "fundamentals", "training", "audits", "ingest"]


def load_all() -> None:
    """Import every query module, which registers its queries."""
    for name in MODULES:
        import_module(f"pitline.catalog.{name}")
