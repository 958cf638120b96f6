"""The whole comparison as one plan for a batch of report pairs: match, diff, rank, suppress what is inherited, group, score."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import DEFAULT, EngineConfig
from ..operators import cascade, diff, filters, match, report
from ..sources.tables import kept, parts_of


def compare(base: DataFrame, comp: DataFrame, mode: str = "static", config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """matches, ambiguous, removed, added, diffs (with inherited), summary, items and score. The elements and the steps of matching are made here and kept; the rest is lazy."""
    parts = parts_of(base)
    base, comp = (kept(filters.first_elements(side, config.max_elements), parts) for side in (base, comp))
    found = match.match(base, comp, config)
    raw = diff.compare(found["matches"], base, comp, config.mode(mode))
    paths = base.selectExpr("pair_id", "ord as b_ord", "hpid")
    diffs = cascade.inherited(raw, paths)
    shown = diffs.where("not inherited").drop("hpid", "inherited", "derived_from")
    items = report.merged(report.items(shown, base))
    return found | {"diffs": diffs, "summary": diff.summary(found["matches"], shown), "items": items, "score": report.score(items)}
