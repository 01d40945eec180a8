"""The registry of queries: a DataFrame plan, and the DuckDB SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None, *views: str) -> Callable[[Plan], Plan]:
        """Register a plan; ``views`` names the derived views that the SQL reads."""

        def keep(plan: Plan) -> Plan:
            if name in self.plans:
                raise ValueError(f"{name} is registered twice")
            self.plans[name] = plan
            if sql is not None:
                from .views import with_views

                self.sql[name] = with_views(sql, views)
            return plan

        return keep


registry = Registry()
query = registry.query
