"""What is dealt by report pair stays in its part: joins, groupings and windows on the pair and more need no exchange."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapsift import fixtures
from snapsift.operators import selectors
from snapsift.plans import catalog
from snapsift.sources.tables import kept

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_kept_rows_meet_without_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [(p, o, f"t{o % 3}") for p in range(40) for o in range(5)]
        t = kept(spark.createDataFrame(rows, "pair_id long, ord long, tag string"), 4)
        sizes = t.groupBy("pair_id", "tag").agg(F.count("*").alias("n"))
        joined = t.join(sizes, ["pair_id", "tag"]).withColumn("number", F.row_number().over(Window.partitionBy("pair_id", "tag").orderBy("ord")))
        assert exchanges(joined) == 0
        assert sorted((r.pair_id, r.ord, r.n) for r in joined.collect()) == sorted((p, o, 2 if o % 3 < 2 else 1) for p, o, _ in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sides_of_a_pair_and_ladders_are_dealt_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        b, c = (fixtures.elements(spark, SF, side) for side in ("base", "compare"))
        paired = b.join(c.select("pair_id", "hpid", F.col("ord").alias("c_ord")), ["pair_id", "hpid"])
        assert exchanges(paired) <= 2  # the lines of each side, and nothing after them
        assert exchanges(selectors.ladder(fixtures.selector_elements(spark, SF), "css")) == 0
        assert exchanges(selectors.tiers(fixtures.selector_elements(spark, SF), "xpath")) == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ladders_send_nothing_through_the_driver(spark):
    """Files of kept rows are small, and what they unpack to is not: a broadcast of them took the driver's memory."""
    for made in (selectors.ladder, selectors.tiers):
        for kind in ("css", "xpath"):
            plan = made(fixtures.selector_elements(spark, SF), kind)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan, (made.__name__, kind)


def test_generators_of_the_diffs_are_given_made_columns(spark):
    """Spark interprets what a generator makes with a lambda in it; columns and names it compiles."""
    plan = catalog.static_diffs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    generators = [line.split("Generate ", 1)[1] for line in plan.splitlines() if "Generate " in line]
    assert len(generators) >= 5 and not [g for g in generators if "lambda" in g]
