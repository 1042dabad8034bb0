"""Column roles: which of a table's columns plays which part.

Operators default to the canonical names below; ``Roles.to_canonical``
renames a table's own columns once (a projection, no data movement), so any
attempt table can feed every operator.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    transaction_id: str = "transaction_id"
    timestamp: str = "timestamp"
    auth_status: str = "auth_status"
    is_retry: str = "is_retry"
    original_transaction_id: str = "original_transaction_id"
    retry_attempt_num: str = "retry_attempt_num"
    hours_since_original: str = "hours_since_original"
    amount_usd: str = "amount_usd"
    response_code: str = "response_code"
    is_soft_decline: str = "is_soft_decline"
    merchant_id: str = "merchant_id"
    merchant_country: str = "merchant_country"
    merchant_vertical: str = "merchant_vertical"
    processor_name: str = "processor_name"
    label: str = "target_recovered_by_retry"

    def to_canonical(self, df: DataFrame, keep_other: bool = True) -> DataFrame:
        """Rename the bound columns to the canonical names (missing ones are skipped)."""
        mapping = {src: canon for canon, src in asdict(self).items() if src in df.columns}
        cols = [F.col(f"`{c}`").alias(mapping[c]) if c in mapping else F.col(f"`{c}`")
                for c in df.columns if c in mapping or keep_other]
        return df.select(*cols)

    def from_canonical(self, df: DataFrame) -> DataFrame:
        """Rename canonical columns back to the table's own names."""
        back = {canon: src for canon, src in asdict(self).items()}
        return df.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in df.columns])
