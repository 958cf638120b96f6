"""Matching: pairs of elements of two snapshots, by keys, by document order and by distance, for all report pairs at once.

Elements carry (pair_id, ord). A key join is one to one by construction: the count of compare elements with a key tells whether a
key is free, unique or ambiguous, and the first baseline element of a key takes its only partner. No loop over elements is needed.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANCHOR_ATTRIBUTES, DEFAULT, EngineConfig
from ..sources.tables import kept, parts_of, written
from .filters import first_elements

#: Strategies that leave an element open where several others have its key.
UNDOUBTING = ("suffix-realign",)
MATCH = "pair_id long, b_ord long, c_ord long, confidence double, strategy string"


def test_attribute_key() -> Column:
    """attr::value of the first anchor attribute that is not empty."""
    value = lambda a: F.col("attributes")[a]
    return F.coalesce(*[F.when(F.coalesce(value(a), F.lit("")) != "", F.concat(F.lit(f"{a}::"), value(a))) for a in ANCHOR_ATTRIBUTES])


def suffix_key(depth: int) -> Column:
    """Tag and last segments of the path, for paths that are deep enough."""
    size = F.size(F.split("hpid", r"\."))
    return F.when(size >= max(2, depth // 2), F.concat_ws("|", "tag_name", F.substring_index("hpid", ".", -depth)))


def strategy_key(strategy: str, config: EngineConfig = DEFAULT) -> Column:
    plain = {"absolute-hpid": "absolute_hpid", "id": "element_id", "css-selector": "css_selector", "xpath": "xpath"}
    if strategy == "test-attribute":
        return test_attribute_key()
    if strategy == "suffix-realign":
        return suffix_key(config.suffix_depth)
    return F.when(F.col(plain[strategy]) != "", F.col(plain[strategy]))


def key_verdicts(base: DataFrame, comp: DataFrame, key: Column, doubts: bool = True) -> DataFrame:
    """pair_id, b_ord, verdict (definitive, ambiguous or orphan), c_ord, candidates (of an ambiguous key, in order).

    Without ``doubts`` an element whose key several others have is an orphan, open for the next strategy.
    """
    keyed_c = comp.select("pair_id", "ord", key.alias("key")).where("key is not null")
    per_key = keyed_c.groupBy("pair_id", "key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("ord")).alias("found"))
    first = F.row_number().over(Window.partitionBy("pair_id", "key").orderBy("ord"))
    keyed_b = base.select("pair_id", F.col("ord").alias("b_ord"), key.alias("key"), "ord").withColumn("rn", first).drop("ord")
    joined = keyed_b.join(per_key, ["pair_id", "key"], "left")
    verdict = F.when((F.col("n") == 1) & (F.col("rn") == 1), "definitive").when(F.lit(doubts) & (F.col("n") >= 2), "ambiguous").otherwise("orphan")
    return joined.select(
        "pair_id",
        "b_ord",
        verdict.alias("verdict"),
        F.when(verdict == "definitive", F.col("found")[0]).alias("c_ord"),
        F.when(verdict == "ambiguous", F.col("found")).alias("candidates"),
    )


def cascade(base: DataFrame, comp: DataFrame, strategies: list[tuple[str, float]], config: EngineConfig = DEFAULT, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches, ambiguous) of key strategies in falling confidence: each sees only what the ones before left over. With ``parts`` they are made once and kept.

    Both sides are dealt by ``pair_id`` once; every strategy is then one window over the elements that share its key, so
    the plan grows by one step a strategy and shuffles nothing more. An ambiguous element is settled; its candidates stay open.
    """
    used = [s for s in sorted(strategies, key=lambda s: -s[1]) if s[1] >= config.min_match]
    keys = [strategy_key(name, config).alias(f"key{k}") for k, (name, _) in enumerate(used)]
    ord_type = base.schema["ord"].dataType.simpleString()
    rows = base.select("pair_id", "ord", F.lit("b").alias("side"), *keys).unionByName(comp.select("pair_id", "ord", F.lit("c").alias("side"), *keys))
    empty = {"settled": "boolean", "c_ord": ord_type, "candidates": f"array<{ord_type}>", "confidence": "double", "strategy": "string"}
    # a value of its own, as in ``align``: the exchange must not be left out where both sides are dealt by pair_id already
    rows = rows.withColumn("deal", F.xxhash64("pair_id")).repartition("deal").withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    for k, (name, confidence) in enumerate(used):
        keyed = F.col("settled").isNull() & F.col(f"key{k}").isNotNull()
        # an element without a key, or settled, is alone in its slot
        slot = F.when(keyed, F.concat(F.lit("="), f"key{k}")).otherwise(F.concat_ws("|", "side", "ord"))
        rows = rows.withColumns({"keyed": keyed, "slot": slot})
        same = Window.partitionBy("deal", "pair_id", "slot")
        of = lambda side: F.when(F.col("keyed") & (F.col("side") == side), F.col("ord"))
        rows = rows.withColumns({"found": F.sort_array(F.collect_list(of("c")).over(same)), "first": F.min(of("b")).over(same)})
        n = F.size("found")
        pair = F.col("keyed") & (n == 1) & ((F.col("ord") == F.col("first")) | (F.col("side") == "c")) & F.col("first").isNotNull()
        doubt = F.lit(name not in UNDOUBTING) & F.col("keyed") & (n >= 2) & (F.col("side") == "b")
        rows = rows.withColumns(
            {
                "settled": F.when(pair | doubt, True).otherwise(F.col("settled")),
                "c_ord": F.when(pair, F.col("found")[0]).otherwise(F.col("c_ord")),
                "candidates": F.when(doubt, F.col("found")).otherwise(F.col("candidates")),
                "confidence": F.when(pair | doubt, F.lit(confidence)).otherwise(F.col("confidence")),
                "strategy": F.when(pair | doubt, F.lit(name)).otherwise(F.col("strategy")),
            }
        ).drop("keyed", "slot", "found", "first", f"key{k}")
    mine = rows.where("side = 'b'").withColumnRenamed("ord", "b_ord")
    if parts:
        mine = kept(mine.where("settled").select("pair_id", "b_ord", "c_ord", "candidates", "confidence", "strategy"), parts)
    out = lambda c: mine.where(F.col(c).isNotNull()).select("pair_id", "b_ord", c, "confidence", "strategy")
    return out("c_ord"), out("candidates")


def nearest(base: DataFrame, comp: DataFrame, cell: int = DEFAULT.cell_px) -> DataFrame:
    """pair_id, b_ord, c_ord, distance: the nearest compare element of the same tag within ``cell`` px, found by grid cells."""
    at = lambda c: F.floor(F.col(f"rect.{c}") / cell)
    spread = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    b = base.where("rect.x is not null and rect.y is not null").select("pair_id", F.col("ord").alias("b_ord"), "tag_name", F.col("rect.x").alias("bx"), F.col("rect.y").alias("by"), at("x").alias("gx"), at("y").alias("gy"), spread.alias("d"))
    b = b.select("pair_id", "b_ord", "tag_name", "bx", "by", (F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy"))
    c = comp.where("rect.x is not null and rect.y is not null").select("pair_id", F.col("ord").alias("c_ord"), "tag_name", F.col("rect.x").alias("cx"), F.col("rect.y").alias("cy"), at("x").alias("gx"), at("y").alias("gy"))
    d = F.sqrt(F.pow(F.col("bx") - F.col("cx"), 2) + F.pow(F.col("by") - F.col("cy"), 2))
    near = b.join(c, ["pair_id", "tag_name", "gx", "gy"]).withColumn("distance", d).where(F.col("distance") < cell)
    return near.groupBy("pair_id", "b_ord").agg(F.min(F.struct("distance", "c_ord")).alias("best")).select("pair_id", "b_ord", "best.c_ord", "best.distance")


#: Confidence of a match in the same place; it falls with the distance.
POSITION = 0.30


def position_matches(base: DataFrame, comp: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """pair_id, b_ord, c_ord, confidence, strategy: in document order each baseline element takes the nearest compare element that is still free.

    That is what proposals come to: every element asks its nearest place, a place keeps the earliest elements up to the number of compare elements that lie there
    and turns the others and all later ones away, who ask their next place, until nobody is turned away. Places that coincide are one with several elements, so
    a heap of elements in one spot is dealt with in one round. Of equal distances the cell to the left, then above, then the first element counts.
    """
    cell = config.cell_px
    known = "rect.x is not null and rect.y is not null"
    at = lambda c: F.floor(F.col(c) / cell)
    spread = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    b = base.where(known).select("pair_id", F.col("ord").alias("b_ord"), "tag_name", F.col("rect.x").alias("bx"), F.col("rect.y").alias("by"), spread.alias("d"))
    b = b.select("pair_id", "b_ord", "tag_name", "bx", "by", F.col("d.dx").alias("dx"), F.col("d.dy").alias("dy"), (at("bx") + F.col("d.dx")).alias("gx"), (at("by") + F.col("d.dy")).alias("gy"))
    spots = comp.where(known).groupBy("pair_id", "tag_name", F.col("rect.x").alias("cx"), F.col("rect.y").alias("cy")).agg(F.sort_array(F.collect_list("ord")).alias("ords"))
    parts = parts_of(base)
    spots = kept(spots.select("pair_id", "tag_name", "cx", "cy", "ords", F.get("ords", 0).alias("spot"), F.size("ords").alias("room"), at("cx").alias("gx"), at("cy").alias("gy")), parts)
    distance = F.sqrt(F.pow(F.col("bx") - F.col("cx"), 2) + F.pow(F.col("by") - F.col("cy"), 2))
    near = b.join(spots, ["pair_id", "tag_name", "gx", "gy"]).withColumn("distance", distance).where(F.col("distance") < cell)
    near = near.withColumn("confidence", F.greatest(F.lit(0.1), 1 - F.col("distance") / cell) * POSITION).where(F.col("confidence") >= config.min_position)
    asks = kept(near.select("pair_id", "b_ord", F.struct("distance", "dx", "dy", "spot", "room", "confidence").alias("place")), parts)
    left = asks.count()
    while True:
        first = asks.groupBy("pair_id", "b_ord").agg(F.min("place").alias("place"))
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "place.spot").orderBy("b_ord")))
        last = ranked.where(F.col("rank") == F.col("place.room")).select("pair_id", F.col("place.spot").alias("spot"), F.col("b_ord").alias("last"))
        stay = asks.withColumn("spot", F.col("place.spot")).join(last, ["pair_id", "spot"], "left").where("last is null or b_ord <= last")
        asks, before = kept(stay.select("pair_id", "b_ord", "place"), parts), left
        left = asks.count()
        if left == before:
            break
    taken = ranked.withColumn("spot", F.col("place.spot")).join(spots.select("pair_id", "spot", "ords"), ["pair_id", "spot"])
    return taken.select("pair_id", "b_ord", F.get("ords", F.col("rank") - 1).alias("c_ord"), F.col("place.confidence").alias("confidence"), F.lit("position").alias("strategy"))


def _align(config: EngineConfig):
    """The in-order pass over two element lists: pairs of equal path and tag, found in step or at most ``look_ahead`` elements further on either side.

    Elements that are used already pair with nothing and are no news, but the look-ahead counts them.
    """
    sure, resync, ahead = config.in_sequence, config.in_sequence - 0.05, config.look_ahead

    def steps(b: list[tuple], c: list[tuple]):
        """Yields (event, baseline ord, compare ord, confidence, strategy); elements are (ord, (path, tag), used)."""
        at = {"removed": 0, "added": 0}
        sides = {"removed": b, "added": c}

        def news(side: str, upto: int):
            """What lies before ``upto`` on one side stays without a partner."""
            free = [x[0] for x in sides[side][at[side] : upto] if not x[2]]
            at[side] = upto
            return [("removed", o, None, None, None) if side == "removed" else ("added", None, o, None, None) for o in free]

        def further(side: str, wanted: tuple) -> int | None:
            first = at[side] + 1
            return next((k for k, x in enumerate(sides[side][first : first + ahead], first) if not x[2] and x[1] == wanted), None)

        while at["removed"] < len(b) and at["added"] < len(c):
            x, y = b[at["removed"]], c[at["added"]]
            if x[2] or y[2]:
                at["removed" if x[2] else "added"] += 1
                continue
            event = ("orphan", x[0], y[0], None, None)
            if x[1] == y[1]:
                event = ("pair", x[0], y[0], sure, "sequence-hpid")
            elif x[1][0] == y[1][0]:  # another tag in the same place
                yield from news("removed", at["removed"] + 1)
                yield from news("added", at["added"] + 1)
                continue
            elif (k := further("added", x[1])) is not None:
                yield from news("added", k)
                event = ("pair", x[0], c[k][0], resync, "sequence-resync-add")
            elif (k := further("removed", y[1])) is not None:
                yield from news("removed", k)
                event = ("pair", b[k][0], y[0], resync, "sequence-resync-remove")
            yield event
            at["removed"], at["added"] = at["removed"] + 1, at["added"] + 1
        yield from news("removed", len(b))
        yield from news("added", len(c))

    def run(batches):
        """Elements of many pairs, in order of pair, side and place; a batch can end within a pair, so one pair is held over."""
        pair, sides = None, {"b": [], "c": []}
        out: list[tuple] = []

        def table():
            rows = pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), _ALIGNED.types, strict=True)], schema=_ALIGNED)
            out.clear()
            return rows.to_batches()

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("pair_id", "side", "ord", "hpid", "tag_name", "used")], strict=True):
                if row[0] != pair:
                    out += [(pair, *s) for s in steps(sides["b"], sides["c"])]
                    pair, sides = row[0], {"b": [], "c": []}
                sides[row[1]].append((row[2], (row[3] or "", row[4]), row[5]))
            if out:
                yield from table()
        out += [(pair, *s) for s in steps(sides["b"], sides["c"])]
        if out:
            yield from table()

    return run


_ALIGNED = pa.schema([("pair_id", pa.int64()), ("event", pa.string()), ("b_ord", pa.int64()), ("c_ord", pa.int64()), ("confidence", pa.float64()), ("strategy", pa.string())])


def align(base: DataFrame, comp: DataFrame, config: EngineConfig = DEFAULT, used: DataFrame | None = None) -> DataFrame:
    """pair_id, event (pair, removed, added, orphan), b_ord, c_ord, confidence, strategy of the in-order pass; ``used`` are matches made before.

    A task takes its pairs of reports one after the other out of sorted rows and holds one of them, of ``config.max_elements`` on a side at most: more are not
    compared (the same limit that extraction has).
    """

    def side(d: DataFrame, o: str) -> DataFrame:
        rows = d.select("pair_id", "ord", "hpid", "tag_name")
        if used is not None:
            rows = rows.join(used.select("pair_id", F.col(o).alias("ord"), F.lit(True).alias("used")), ["pair_id", "ord"], "left")
        taken = F.lit(False) if used is None else F.coalesce("used", F.lit(False))
        return rows.select(F.col("pair_id").cast("long").alias("pair_id"), F.lit(o[0]).alias("side"), F.col("ord").cast("long").alias("ord"), "hpid", "tag_name", taken.alias("used"))

    left, right = (side(first_elements(d, config.max_elements), o) for d, o in ((base, "b_ord"), (comp, "c_ord")))
    # dealt by a value that neither side is dealt by: adaptive plans would leave out the exchange, though they merge the partitions of the two sides differently
    rows = left.unionByName(right).repartition(F.xxhash64("pair_id")).sortWithinPartitions("pair_id", "side", "ord")
    return rows.mapInArrow(_align(config), "pair_id long, event string, b_ord long, c_ord long, confidence double, strategy string")


#: What matching reads of an element.
READ = ("pair_id", "ord", "hpid", "absolute_hpid", "tag_name", "element_id", "css_selector", "xpath", "attributes", "rect")


def match(base: DataFrame, comp: DataFrame, config: EngineConfig = DEFAULT) -> dict[str, DataFrame]:
    """matches, ambiguous, removed and added: test attributes, then document order, then the other strategies for what is left.

    With alignment both sides and what each step finds are read many times by the next ones, so they are made once and kept by report pair.
    """
    parts = parts_of(base) if config.alignment else None
    if parts:
        base, comp = (kept(d.select(*[c for c in READ if c in d.columns]), parts) for d in (base, comp))
    anchored, ambiguous = cascade(base, comp, [s for s in config.strategies if s[0] == "test-attribute"], config, parts)
    strip = lambda d, m, o: d.join(m.select("pair_id", F.col(o).alias("ord")), ["pair_id", "ord"], "left_anti")
    left_b, left_c = strip(base, anchored, "b_ord"), strip(comp, anchored, "c_ord")
    later = [s for s in config.strategies if s[0] not in ("test-attribute", "position")]
    if config.alignment:
        steps = kept(align(base, comp, config, anchored), parts)
        found = steps.where("event = 'pair'").select("pair_id", "b_ord", "c_ord", "confidence", "strategy")
        removed = steps.where("event = 'removed'").select("pair_id", F.col("b_ord").alias("ord"))
        added = steps.where("event = 'added'").select("pair_id", F.col("c_ord").alias("ord"))
        if config.drop_alignment_orphans:
            return {"matches": anchored.unionByName(found), "ambiguous": ambiguous, "removed": removed, "added": added}
        orphans = steps.where("event = 'orphan'")
        left_b = base.join(orphans.select("pair_id", F.col("b_ord").alias("ord")), ["pair_id", "ord"], "left_semi")
        left_c = comp.join(orphans.select("pair_id", F.col("c_ord").alias("ord")), ["pair_id", "ord"], "left_semi")
        later = [("suffix-realign", config.suffix_confidence), *later]
    else:
        found, removed, added = anchored.limit(0), base.select("pair_id", "ord").limit(0), comp.select("pair_id", "ord").limit(0)
    more, doubtful = cascade(left_b, left_c, later, config, parts)
    reserved = doubtful.select("pair_id", F.explode("candidates").alias("c_ord"))
    rest_b, rest_c = strip(strip(left_b, more, "b_ord"), doubtful, "b_ord"), strip(strip(left_c, more, "c_ord"), reserved, "c_ord")
    if config.min_position <= POSITION and any(s == "position" for s, _ in config.strategies):  # else no distance is small enough
        placed = written(position_matches(rest_b, rest_c, config))
        more, rest_b, rest_c = more.unionByName(placed), strip(rest_b, placed, "b_ord"), strip(rest_c, placed, "c_ord")
    rest_b, rest_c = rest_b.select("pair_id", "ord"), rest_c.select("pair_id", "ord")
    return {
        "matches": reduce(DataFrame.unionByName, [anchored, found, more]),
        "ambiguous": ambiguous.unionByName(doubtful),
        "removed": removed.unionByName(rest_b),
        "added": added.unionByName(rest_c),
    }


def rate(matches: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """pair_id, matched, removed, added, rate: the rounded percentage of matched among all."""
    one = lambda d, n: d.groupBy("pair_id").agg(F.count("*").alias(n))
    joined = one(matches, "matched").join(one(removed, "removed"), "pair_id", "full").join(one(added, "added"), "pair_id", "full").na.fill(0)
    total = F.col("matched") + F.col("removed") + F.col("added")
    return joined.withColumn("rate", F.when(total == 0, 0).otherwise(F.floor(100 * F.col("matched") / total + 0.5)).cast("long"))


def metadata(matches: DataFrame, ambiguous: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """``rate`` with the number of ambiguous elements and ``by_strategy``: strategy -> matches."""
    per = matches.groupBy("pair_id", "strategy").agg(F.count("*").alias("n"))
    named = per.groupBy("pair_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("strategy", "n")))).alias("by_strategy"))
    doubtful = ambiguous.groupBy("pair_id").agg(F.count("*").alias("ambiguous"))
    joined = rate(matches, removed, added).join(doubtful, "pair_id", "left").join(named, "pair_id", "left")
    return joined.na.fill(0, ["ambiguous"]).withColumn("by_strategy", F.coalesce("by_strategy", F.create_map().cast("map<string,bigint>")))
