"""Who may see what: closed unless opened on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def allow_all(x: DataFrame, opted_in: bool = False) -> DataFrame:
    """Every row, but only for a caller who says so; a missing opt-in fails."""
    if not opted_in:
        raise PermissionError("open access needs an explicit opt-in")
    return x


def fail_closed(x: DataFrame, resolve: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Rows whose key a resolver returns; no row at all when the resolver fails or returns something without that key.

    The resolver's plan is analysed here; a fault while it runs fails the whole query, which shows nothing either.
    """
    try:
        allowed = resolve(x)
        if not isinstance(allowed, DataFrame) or key not in allowed.columns:
            return x.where(F.lit(False))
        return x.join(allowed.select(key).distinct(), key, "left_semi")
    except Exception:  # a resolver may fail in any way; nothing may show then
        return x.where(F.lit(False))
