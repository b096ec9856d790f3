"""Optional predicates over facts as one condition."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FactFilter:
    """Each field that is set is one predicate; all must hold. Empty lists and bounds of 0 or less are not set."""

    types: Sequence[str] = ()
    statuses: Sequence[str] = ()
    tags: Sequence[str] = ()
    slots: Sequence[str] = ()
    source_roles: Sequence[str] = ()
    thread_statuses: Sequence[str] = ()
    valences: Sequence[str] = ()
    min_significance: int = 0
    max_significance: int = 0
    min_confidence: float = 0.0
    exclude_expired: bool = False
    unembedded_only: bool = False
    reference_after: str | None = None
    reference_before: str | None = None
    pinned: bool | None = None
    extra: Sequence[Column] = field(default=())

    def condition(self, as_of: Column) -> Column:
        """The conjunction; plain comparisons, so that the scan can take them over."""
        parts: list[Column] = list(self.extra)
        for name, values in (
            ("fact_type", self.types), ("temporal_status", self.statuses), ("tag", self.tags), ("slot", self.slots), ("source_role", self.source_roles),
            ("thread_status", self.thread_statuses), ("emotional_valence", self.valences),
        ):
            if values:
                parts.append(F.col(name).isin(*values))
        if self.min_significance > 0:
            parts.append(F.col("significance") >= self.min_significance)
        if self.max_significance > 0:
            parts.append(F.col("significance") <= self.max_significance)
        if self.min_confidence > 0:
            parts.append(F.col("confidence") >= self.min_confidence)
        if self.exclude_expired:
            parts.append(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
        if self.unembedded_only:
            parts.append(F.col("embedding").isNull())
        if self.reference_after is not None:
            parts.append(F.col("reference_time") >= self.reference_after)
        if self.reference_before is not None:
            parts.append(F.col("reference_time") <= self.reference_before)
        if self.pinned is not None:
            parts.append(F.col("pinned") == self.pinned)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out


def significance_label(col: Column | str) -> Column:
    return F.when(F.col(col) >= 10, "high").when(F.col(col) >= 5, "medium").otherwise("low")


def significance_of(label: Column | str) -> Column:
    low = F.lower(F.col(label))
    return F.when(low == "high", 10).when(low == "medium", 5).when(low == "low", 1).otherwise(5)
