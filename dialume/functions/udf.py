"""Arrow-batched functions that can be declared before a session exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(returns: str) -> Callable:
    """Like ``pandas_udf``, but bound to the session when first used in a query."""

    def declare(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        call.plain = f
        return call

    return declare
