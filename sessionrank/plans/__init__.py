"""Named queries: what each operator gives on the driver tables, with the SQL that checks it."""

from importlib import import_module

from sessionrank.plans.registry import QUERIES, SQL

for _name in ("scans", "cleaning", "joins", "aggregates", "windows", "scalars", "ranking", "encodings", "learning", "streams"):
    try:
        import_module(f"sessionrank.plans.{_name}")
    except ModuleNotFoundError as e:
        if not str(e).endswith(f"plans.{_name}'"):
            raise

__all__ = ["QUERIES", "SQL"]
