"""Who may see what: scopes, roles and tenants as row filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Principal:
    tenant: str | None = None
    scopes: tuple[str, ...] = ()
    role: str = "member"

    @property
    def is_admin(self) -> bool:
        return self.role == "admin" or "admin" in self.scopes

    def has_scope(self, scope: str) -> bool:
        return self.is_admin or scope in self.scopes

    def has_any_scope(self, *scopes: str) -> bool:
        return any(map(self.has_scope, scopes))


def visible(df: DataFrame, who: Principal, column: str = "tenant_id") -> DataFrame:
    """All rows for an admin, else those of the principal's tenant; none without a tenant."""
    if who.is_admin:
        return df
    return df.where(F.col(column) == F.lit(who.tenant))


def clamp(value: int | None, default: int, most: int, least: int = 0) -> int:
    """A paging parameter: the default where it is missing or too small, at most ``most``."""
    if value is None or value < least or value == 0 and least == 0 and default:
        return default
    return min(value, most)


def csv_values(text: str | None) -> list[str]:
    return [x.strip().lower() for x in (text or "").split(",") if x.strip()]
