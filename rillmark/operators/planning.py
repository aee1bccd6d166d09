"""The retrieval plan as columns, so that a batch of mixed queries shares one Spark plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .understanding import LAW_DOMAINS

#: Laws a domain prefers, in order.
PREFERRED = {
    "employment": ("local:sb/2006/262",),
    "civil": ("local:sb/2012/89", "local:sb/1963/99", "local:sb/2013/292"),
    "criminal": ("local:sb/2009/40", "local:sb/1961/141"),
    "tax": ("local:sb/1992/586",),
    "administrative": ("local:sb/2004/500",),
    "constitutional": ("local:sb/1993/1",),
    "corporate": ("local:sb/2012/90",),
}
assert {x for laws in PREFERRED.values() for x in laws} == set(LAW_DOMAINS)

#: Fixed values by plan: candidate baseline, boosts for law, paragraph, preferred law, exact
#: match and neighbour, overlap weight, mismatch penalty, mode, structural window.
PLANS = {
    "exact": (80, 0.34, 0.42, 0.18, 0.48, 0.06, 0.24, 0.50, "exact", 1),
    "topic": (120, 0.32, 0.30, 0.12, 0.35, 0.06, 0.32, 0.45, "constrained", 2),
    "law": (75, 0.32, 0.30, 0.12, 0.35, 0.06, 0.26, 0.45, "constrained", 1),
    "domain_sure": (90, 0.32, 0.24, 0.24, 0.30, 0.05, 0.30, 0.12, "constrained", 1),
    "domain": (90, 0.0, 0.24, 0.24, 0.30, 0.05, 0.30, 0.12, "constrained", 1),
    "broad": (100, 0.0, 0.18, 0.12, 0.24, 0.04, 0.32, 0.05, "broad", 1),
    "broadened": (100, 0.30, 0.32, 0.16, 0.42, 0.05, 0.28, 0.35, "broad", 1),
}
FIELDS = ("baseline", "law_boost", "paragraph_boost", "preferred_boost", "exact_boost", "neighbor_boost", "overlap_weight", "mismatch", "plan_mode", "window")
SURE = 0.9


def candidate_k(top_k: Column, baseline: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(50), baseline, top_k * 10)).cast("int")


def generic_candidates(top_k: Column) -> Column:
    return F.least(F.greatest(top_k * 4, top_k), F.lit(25))


def _of(name: Column, field: str) -> Column:
    at = FIELDS.index(field)
    out = None
    for key, values in PLANS.items():
        out = F.when(name == key, F.lit(values[at])) if out is None else out.when(name == key, F.lit(values[at]))
    return out


def _laws(domain: Column) -> Column:
    out = None
    for d, laws in PREFERRED.items():
        value = F.array(*[F.lit(x) for x in laws])
        out = F.when(domain == d, value) if out is None else out.when(domain == d, value)
    return out.otherwise(F.array().cast("array<string>"))


def build(understood: DataFrame) -> DataFrame:
    """Adds the plan's columns to understood queries (with top_k, document_ids,
    forced_paragraph and forced_law, each of which may be missing)."""
    have = understood.columns
    none = F.lit(None).cast("string")
    top_k = F.col("top_k") if "top_k" in have else F.lit(5)
    ids = F.coalesce("document_ids", F.array().cast("array<string>")) if "document_ids" in have else F.array().cast("array<string>")
    paragraph = F.col("forced_paragraph") if "forced_paragraph" in have else none
    law = F.col("forced_law") if "forced_law" in have else none
    explicit = F.array_distinct(F.concat("laws", ids))
    name = (
        F.when(F.col("mode") == "exact_lookup", "exact")
        .when((F.col("mode") == "law_constrained_search") & (F.size("paragraphs") == 0), "topic")
        .when(F.col("mode") == "law_constrained_search", "law")
        .when((F.col("mode") == "domain_search") & (F.col("domain_confidence") >= SURE), "domain_sure")
        .when(F.col("mode") == "domain_search", "domain")
        .otherwise("broad")
    )
    none_yet = F.array().cast("array<string>")
    rows = understood.withColumns({"plan": name, "_preferred": F.when(F.size(explicit) > 0, explicit).otherwise(_laws(F.col("domain"))), "_explicit": explicit})
    hard = F.when(F.col("plan").isin("exact", "topic", "law"), F.col("_explicit")).when(F.col("plan") == "domain_sure", F.col("_preferred")).otherwise(none_yet)
    hard = F.when(law.isNotNull(), F.array_distinct(F.concat(hard, F.array(law)))).otherwise(hard)
    rows = rows.withColumn("law_filter", hard)
    rows = rows.withColumn("preferred_laws", F.when(law.isNotNull() & (F.size("_preferred") == 0), F.col("law_filter")).otherwise(F.col("_preferred")))
    rows = rows.withColumns({f: _of(F.col("plan"), f) for f in FIELDS})
    rows = rows.withColumns({"paragraph_filter": F.when(paragraph.isNotNull(), F.array(paragraph.cast("string"))).otherwise(F.col("paragraphs")), "plan_mode": F.when(paragraph.isNotNull(), "exact").otherwise(F.col("plan_mode")), "candidate_k": candidate_k(top_k, F.col("baseline"))})
    return rows.drop("_preferred", "_explicit", "baseline")


def broaden(planned: DataFrame) -> DataFrame:
    """The one wider plan: an exact one loses its paragraphs, a constrained one with laws
    too; any other becomes broad with default boosts."""
    top_k = F.col("top_k") if "top_k" in planned.columns else F.lit(5)
    exact = F.col("plan_mode") == "exact"
    keep = exact | ((F.col("plan_mode") == "constrained") & (F.size("law_filter") > 0))
    none_yet = F.array().cast("array<string>")
    boosts = {f: F.when(keep, F.col(f)).otherwise(F.lit(PLANS["broadened"][FIELDS.index(f)])) for f in FIELDS if f not in ("baseline", "plan_mode")}
    return planned.withColumns(
        boosts
        | {
            "law_filter": F.when(keep, F.col("law_filter")).otherwise(none_yet),
            "preferred_laws": F.when(keep, F.col("preferred_laws")).otherwise(_laws(F.col("domain"))),
            "paragraph_filter": none_yet,
            "candidate_k": candidate_k(top_k, F.when(exact, 90).otherwise(100)),
            "plan_mode": F.when(keep, "constrained").otherwise("broad"),
        }
    )
