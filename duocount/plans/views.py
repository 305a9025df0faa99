"""The reference's views as whole-table plans: gene viewer and Venn view (3.2).

The reference recomputes these per click for one gene or one slider position; here one job
produces the table for every gene (or every threshold), and a single gene is a filter on the result.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.functions.scalar import gene_label
from duocount.operators import compare as cmp
from duocount.operators import insertions as I
from duocount.operators import sets as S
from duocount.spec import ComparisonSpec


def gene_viewer(features: DataFrame, ins: DataFrame, keys: Sequence[str], by: Sequence[str] = (),
                bounds: str = "open", buffer_frac: float = 0.0, bin_width=None):
    """``(wide, totals)``: per-site control/test counts in every gene window, sorted by gene and
    position (J02, F04, F05, O01), and per-gene totals within the CDS (A04) with gene labels (P11)."""
    sites = I.insertion_sites(ins, by)
    wide = (I.gene_window_table(features, sites, keys, by, bounds, buffer_frac, bin_width)
            .orderBy(*by, "seq_id", "start_pos", "locus_tag", "position"))
    totals = (I.feature_totals(features, sites, keys, by, I.CONDITIONS, bounds, buffer_frac, bin_width)
              .withColumn("label", gene_label()))
    return wide, totals


def one_gene(wide: DataFrame, locus_tag: str) -> DataFrame:
    """The clicked gene: a filter on the all-genes table."""
    return cmp.lookup(wide, locus_tag).orderBy("position")


def venn_view(merged: DataFrame, spec: ComparisonSpec, threshold: float = 0.0,
              pct_range=(0.0, 100.0), region: str = "all", by: Sequence[str] = ()):
    """``(table, counts)``: membership, labels and truncation flags per entity
    and the three region sizes (A07), from one lazy plan over the merged table."""
    m = S.add_truncation_flags(S.add_set_membership(merged, spec, threshold, pct_range), spec)
    return S.filter_region(m, region), S.venn_counts(m, by)
