"""Label list helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from communitylens.functions.lexicons import LABEL_EXPANSION, PRECEDENCE_OVER_ADVOCATE


def label_precedence(labels: Column) -> Column:
    """Drop 'advocate' when hpo, hpi or research is present; expand
    short codes ('P' -> 'Patient')."""
    prec = F.array(*[F.lit(x) for x in PRECEDENCE_OVER_ADVOCATE])
    kept = F.when(F.arrays_overlap(labels, prec), F.filter(labels, lambda x: x != "advocate")).otherwise(labels)
    expand = F.create_map(*[F.lit(x) for kv in LABEL_EXPANSION.items() for x in kv])
    return F.transform(kept, lambda x: F.coalesce(F.try_element_at(expand, x), x))
