"""Visual evidence: keyframes over document coordinates, clipped rectangles, one manifest row per element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

PAD = 40


def clusters(elements: DataFrame) -> DataFrame:
    """pair_id, root, top, bottom, n: elements (pair_id, hpid, document_y, height) by the first segment of their path."""
    root = F.substring_index("hpid", ".", 1)
    return elements.groupBy("pair_id", root.alias("root")).agg(F.min("document_y").alias("top"), F.max(F.col("document_y") + F.col("height")).alias("bottom"), F.count("*").alias("n"))


def _reached(jumps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i: the places that are reached from place 1 by following ``next`` again and again (keys, i, next > i), with steps that double in length."""
    reached = jumps.where("i = 1").select(*keys, "i")
    while True:
        ahead = written(reached.join(jumps, [*keys, "i"]).select(*keys, F.col("next").alias("i")))
        if ahead.isEmpty():
            return reached
        reached = written(reached.unionByName(ahead))
        further = jumps.select(*keys, F.col("i").alias("next"), F.col("next").alias("after"))
        jumps = written(jumps.join(further, [*keys, "next"]).select(*keys, "i", F.col("after").alias("next")))


def keyframes(elements: DataFrame, viewport: int) -> DataFrame:
    """pair_id, ord, frame, scroll_y: a frame for each cluster that fits the viewport, frames packed greedily along those that don't.

    ``elements`` has pair_id, ord, hpid, document_y, height and document_height. Along a cluster that does not fit, elements stand by their tops; a frame
    ends before the first element that starts below it, so every element knows the element that the next frame would start with, had it started one itself. The
    frames are those reached from the first element. At least one element goes into every frame, so that packing ends wherever an element lies.
    """
    keys = ["pair_id", "root"]
    rows = written(elements.select("pair_id", "ord", F.substring_index("hpid", ".", 1).alias("root"), F.col("document_y").alias("y"), "height", "document_height"))
    boxes = rows.groupBy(*keys).agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("low"), F.min("ord").alias("first"), F.max("document_height").alias("total"))
    boxes = boxes.withColumns({"total": F.max("total").over(Window.partitionBy("pair_id")), "fits": F.col("low") - F.col("top") <= viewport})
    clamp = lambda y: F.when(F.col("total") <= viewport, 0).otherwise(F.floor(F.greatest(F.lit(0), F.least(y, F.col("total") - viewport)))).cast("long")
    along = Window.partitionBy(*keys).orderBy("i")
    long = rows.join(boxes.where("not fits").select(*keys, "total"), keys)
    long = written(long.select("pair_id", "root", "ord", "y", clamp(F.col("y") - PAD).alias("scroll_y"), F.row_number().over(Window.partitionBy(*keys).orderBy("y", "ord")).alias("i")))
    # elements and frames' ends in one order: the next frame starts with the first element at or below the end
    ends = long.select(*keys, "i", (F.col("scroll_y") + viewport).alias("at"), F.lit(0).alias("is_element"))
    order = Window.partitionBy(*keys).orderBy("at", "is_element").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    marks = ends.unionByName(long.select(*keys, "i", F.col("y").alias("at"), F.lit(1).alias("is_element")))
    following = marks.withColumn("next", F.min(F.when(F.col("is_element") == 1, F.col("i"))).over(order)).where("is_element = 0 and next is not null")
    starts = _reached(written(following.select(*keys, "i", F.greatest("next", F.col("i") + 1).alias("next"))), keys)
    starts = starts.unionByName(long.where("i = 1").select(*keys, "i")).distinct().withColumn("starts", F.lit(True))  # a cluster of one frame has no next
    packed = long.join(starts, [*keys, "i"], "left")
    packed = packed.select(*keys, "ord", F.count("starts").over(along).alias("within"), F.last(F.when(F.col("starts"), F.col("scroll_y")), ignorenulls=True).over(along).alias("scroll_y"))
    one = boxes.where("fits").select(*keys, F.lit(1).cast("long").alias("within"), clamp((F.col("top") + F.col("low")) / 2 - viewport / 2).alias("scroll_y"))
    packed = written(packed.unionByName(rows.select(*keys, "ord").join(one, keys).select(*keys, "ord", "within", "scroll_y")))
    frames = packed.groupBy(*keys).agg(F.max("within").alias("frames")).join(boxes.select(*keys, "top", "first"), keys)
    before = F.coalesce(F.sum("frames").over(Window.partitionBy("pair_id").orderBy("top", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    done = packed.join(frames.select(*keys, before.alias("before")), keys)
    return done.select("pair_id", "ord", (F.col("before") + F.col("within") - 1).alias("frame"), "scroll_y")


def clip(rects: DataFrame, viewport: int) -> DataFrame:
    """``rects`` (viewport_y, height, found) with clipped_y, clipped_height, clipped, and why a rectangle is misaligned."""
    y, bottom = F.greatest(F.lit(0), F.col("viewport_y")), F.least(F.col("viewport_y") + F.col("height"), F.lit(viewport))
    height = F.greatest(F.lit(1), bottom - y)
    usable = F.col("found") & (bottom > 0)
    return rects.select(
        "*",
        F.when(usable, y).alias("clipped_y"),
        F.when(usable, height).alias("clipped_height"),
        F.when(~F.col("found"), False).when(bottom <= 0, True).otherwise(height < F.col("height")).alias("clipped"),
        F.when(~F.col("found"), "element-not-found").when(bottom <= 0, "clipped-below-fold").alias("misaligned"),
    )


def manifest(base: DataFrame, comp: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per element that either side has: base_* and compare_* columns."""
    side = lambda d, p: d.select(*keys, *[F.col(f).alias(f"{p}_{f}") for f in fields])
    return side(base, "base").join(side(comp, "compare"), keys, "full")


#: The gap that open DevTools leave, the browser's own bars, the least height of a capture, thumbnails.
DEVTOOLS_GAP, BROWSER_BARS, LEAST_HEIGHT = 200, 88, 400
THUMB_SHARE, THUMB_HEIGHT, LEAST_SCALE, MARGIN, MOST_MARGIN = 0.78, 140, 0.25, 30, 28
# End of fixed values.


def devtools(outer_height: Column, height: Column, outer_width: Column, width: Column) -> Column:
    """struct(detected, bypass_height): whether DevTools take part of a window, and the height of the viewport that is used instead."""
    gap = lambda outer, inner: F.coalesce(outer, F.lit(0)) - inner > DEVTOOLS_GAP
    detected = gap(outer_height, height) | gap(outer_width, width)
    bypass = F.greatest(F.lit(LEAST_HEIGHT), F.coalesce(F.nullif(outer_height, F.lit(0)), height) - BROWSER_BARS)
    return F.struct(detected.alias("detected"), F.when(detected, bypass).alias("bypass_height"))


def keyframe_id(session: Column, role: Column, frame: Column) -> Column:
    return F.concat_ws("_", session, role, frame)


def frames_differ(base_id: Column, compare_id: Column) -> Column:
    """Whether the keyframes of the two roles have different numbers (the kf_<n> at the end)."""
    number = lambda c: F.regexp_extract(c, r"kf_(\d+)$", 1)
    return F.coalesce(number(base_id) != number(compare_id), F.lit(False))


def rail_position(document_y: Column, document_height: Column) -> Column:
    """Percent of the page's height, kept between 3 and 97; null without a height."""
    return F.when(document_height > 0, F.least(F.lit(97), F.greatest(F.lit(3), F.floor(document_y / document_height * 100 + 0.5)))).cast("long")


def crop(rect: Column, image_width: Column, image_height: Column, container: Column, dpr: Column) -> Column:
    """struct of the padded rectangle around an element and its scale in a thumbnail."""
    ratio = F.coalesce(F.nullif(dpr, F.lit(0)), F.lit(2))
    wide, high = image_width / ratio, image_height / ratio
    w = F.coalesce(F.nullif(rect["width"], F.lit(0)), F.lit(1))
    h = F.least(F.coalesce(F.nullif(rect["height"], F.lit(0)), F.lit(1)), F.greatest(F.lit(1), high - F.greatest(F.lit(0), rect["y"])))
    scale = F.greatest(F.least(container * THUMB_SHARE / w, THUMB_HEIGHT / F.greatest(h, F.lit(1))), F.lit(LEAST_SCALE))
    margin = F.least(MARGIN / scale, F.lit(MOST_MARGIN))
    start = lambda at, size, of: F.greatest(F.lit(0), F.least(at - margin, of - size - 1))
    x, y = start(rect["x"], w, wide), start(rect["y"], h, high)
    size = lambda at, extent, of, begin: F.greatest(F.least(of, at + extent + margin) - begin, F.lit(1))
    return F.struct(x.alias("x"), y.alias("y"), size(rect["x"], w, wide, x).alias("width"), size(rect["y"], h, high, y).alias("height"), scale.alias("scale"))


def remeasured(planned: DataFrame, measured: DataFrame, positions: DataFrame, viewport: int) -> DataFrame:
    """One row per planned element (frame, id): its clipped rectangle as measured again, its place in the document, and why it is misaligned.

    ``measured`` has frame, id, found, in_viewport, viewport_x, viewport_y, width, height, matches and reason; ``positions`` has id and document_y.
    """
    m = planned.join(measured, ["pair_id", "frame", "id"], "left").join(positions, ["pair_id", "id"], "left")
    m = clip(m.withColumn("found", F.coalesce("found", F.lit(False))), viewport)
    usable = F.col("found") & F.col("clipped_y").isNotNull()
    why = F.when(usable & ~F.col("in_viewport"), F.col("reason")).when(usable, None).when(F.col("found"), "clipped-below-fold").otherwise(F.coalesce("reason", F.lit("element-not-found")))
    return m.select(
        "pair_id", "frame", "id", "document_y", F.when(usable, F.col("viewport_x")).alias("x"), F.col("clipped_y").alias("y"), F.when(usable, F.col("width")).alias("width"), F.col("clipped_height").alias("height"),
        F.when(usable, F.col("viewport_y")).alias("raw_y"), F.when(usable, F.col("height")).alias("raw_height"), (~usable | ~F.col("in_viewport")).alias("misaligned"), why.alias("misalign_reason"),
        F.col("clipped").alias("rect_clipped"), (usable & (F.coalesce("matches", F.lit(1)) > 1)).alias("selector_ambiguous"),
    )


def with_pseudo(manifest_rows: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Styles of ::before and ::after (pair_id, id, before, after) on the manifest rows that exist."""
    return manifest_rows.join(pseudo.select("pair_id", "id", F.col("before").alias("pseudo_before"), F.col("after").alias("pseudo_after")), ["pair_id", "id"], "left")


def selectors_of(ids: DataFrame, elements: DataFrame) -> DataFrame:
    """css_selector and xpath of the listed elements (pair_id, id); ids without an element, or without any selector, are left out."""
    known = elements.select("pair_id", F.col("hpid").alias("id"), "css_selector", "xpath")
    return ids.join(known, ["pair_id", "id"]).where(F.col("css_selector").isNotNull() | F.col("xpath").isNotNull())


#: The fields of a manifest row, for each side.
FIELDS = ["keyframe_id", "dpr", "scroll_y", "document_y", "document_height", "x", "y", "width", "height", "raw_y", "misaligned", "misalign_reason", "selector_ambiguous", "rect_clipped"]


def flat_manifest(base: DataFrame, comp: DataFrame, keys: list[str], dpr: int = 2) -> DataFrame:
    """One row per element that either side has, with all ``FIELDS`` as baseline_* and compare_*; an unknown pixel ratio is ``dpr``."""
    side = lambda d, p: d.select(*keys, *[(F.coalesce(f, F.lit(dpr)) if f == "dpr" else F.col(f)).alias(f"{p}_{f}") for f in FIELDS])
    return side(base, "baseline").join(side(comp, "compare"), keys, "full")
