"""Rows of one tenant: the only way the retrieval plans get their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    """The id doesn't exist for this tenant."""


class TenantScope:
    """Tables reduced to one tenant. A tenant of None sees nothing; writes of other tenants' rows are refused."""

    def __init__(self, tenant_id: str | None):
        self.tenant_id = tenant_id

    def rows(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col("tenant_id") == self.tenant_id) if self.tenant_id is not None else df.filter(F.lit(False))

    def one(self, df: DataFrame, key: str) -> DataFrame:
        found = self.rows(df).filter(F.col("id") == key).limit(1)
        if found.isEmpty():
            raise NotFoundError(key)
        return found

    def checked(self, df: DataFrame) -> DataFrame:
        """``df`` as it is; its evaluation fails if it holds rows of another tenant."""
        own = F.col("tenant_id").eqNullSafe(self.tenant_id) if self.tenant_id is not None else F.lit(False)
        return df.filter(F.when(own, True).otherwise(F.raise_error(F.lit("row of another tenant")).cast("boolean")))
