"""Column expressions over events: anchors, predicates, rarity and relevance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailgrain.schema import DESTINATION_ANCHORED, READ_LIKE

EXECUTABLE = r"\.(exe|dll|so|sh|ps1|bat)$"


def _relation() -> Column:
    return F.upper(F.col("relation"))


def investigation_anchor() -> Column:
    """The end from which a point of interest is traced."""
    return F.when(_relation().isin(*DESTINATION_ANCHORED), F.col("dst")).otherwise(F.col("src"))


def backward_anchor() -> Column:
    """The end whose history can explain an event."""
    return F.when(_relation().isin(*READ_LIKE), F.col("dst")).otherwise(F.col("src"))


def forward_anchor() -> Column:
    """The end whose later activity an event exposes; relations of other vocabularies keep their direction."""
    return F.when(_relation().isin(*DESTINATION_ANCHORED) | ~_relation().startswith("EVENT_"), F.col("dst")).otherwise(F.col("src"))


def causal_source() -> Column:
    return F.when(_relation() == "EVENT_EXECUTE", F.col("dst")).otherwise(F.col("src"))


def causal_target() -> Column:
    return F.when(_relation() == "EVENT_EXECUTE", F.col("src")).otherwise(F.col("dst"))


def log_rarity(count: Column, largest: Column) -> Column:
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.log1p(count) / F.log1p(largest)))
    return F.when((largest <= 0) | (count <= 0), 1.0).when(largest == 1, 0.0).otherwise(value)


def data_flow_relevance(size: Column, poi_size: Column, alpha: float = 1e-4) -> Column:
    """Null where a size is unknown."""
    return 1 / (F.abs(size.cast("double") - poi_size.cast("double")) + alpha)


def temporal_relevance(time_ns: Column, poi_ns: Column, least_seconds: float = 1e-10) -> Column:
    return F.log1p(1 / F.greatest(F.abs(time_ns - poi_ns) / 1e9, F.lit(least_seconds)))


def temporal_affinity(distance_ns: Column, scale_ns: int) -> Column:
    return 1 / (1 + distance_ns / scale_ns)


def signature() -> Column:
    """Interaction without instance: relation, and types and semantic keys of both ends."""
    return F.to_json(F.array(*[F.lower(c) for c in ("relation", "src_type", "src_semantic", "dst_type", "dst_semantic")]))


def csv_safe(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(F.ltrim(text).rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def masked_home(path: Column) -> Column:
    """User names in home folders become *; the three patterns are fixed values, as keys must match."""
    path = F.regexp_replace(path, r"(?i)(/home/)[^/]+", "$1*")
    path = F.regexp_replace(path, r"(?i)(/users/)[^/]+", "$1*")
    return F.regexp_replace(path, r"(?i)([a-z]:\\users\\)[^\\]+", "$1*")
