"""Run specification and typed errors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Optional, Sequence


class DuocountError(Exception):
    """Base class of every error raised by the library."""


class SchemaError(DuocountError):
    """A required column is missing, or a discovery pattern matched zero or several columns."""


class NotAComparisonError(DuocountError):
    """A two-condition operator was called on a control-only run."""


class CountDataError(DuocountError):
    """Count data unusable for differential abundance (non-integer counts, no gene positive everywhere)."""


# The eight annotation columns that identify a feature in a per-gene table, and the
# two condition suffixes added to every other column when two tables are merged.
FEATURE_KEYS = ("seq_id", "locus_tag", "type", "gene", "start_pos", "end_pos", "feat_length", "product")
CONTROL_SUFFIX = "_control"
TEST_SUFFIX = "_test"


@dataclass(frozen=True)
class ComparisonSpec:
    """Names the columns of one comparison; immutable, so every step can be re-run from it.

    ``run_cols`` are the grouping keys that separate experiments (empty for a single run).
    ``test_suffix=None`` marks a control-only run (S09).
    """

    keys: Sequence[str] = FEATURE_KEYS
    run_cols: Sequence[str] = ()
    control_suffix: str = CONTROL_SUFFIX
    test_suffix: Optional[str] = TEST_SUFFIX
    score_marker: str = "nim_score"
    reads_marker: str = "nrm_score"
    pct_marker: str = "insert_pct"
    pool_marker: str = "_MP"
    metrics: Sequence[str] = field(default_factory=tuple)

    @property
    def control_only(self) -> bool:
        return self.test_suffix is None

    @property
    def all_keys(self) -> list:
        return list(self.run_cols) + [k for k in self.keys if k not in self.run_cols]

    def with_metric(self, name: str) -> "ComparisonSpec":
        if name in self.metrics:
            return self
        return replace(self, metrics=tuple(self.metrics) + (name,))

    def require_comparison(self) -> None:
        if self.control_only:
            raise NotAComparisonError("this operator needs a test condition; the run is control-only")
