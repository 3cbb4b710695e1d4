import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tripleweave.functions import bloom
from tripleweave.operators import layouts, stats
from tripleweave.operators import reductions as red
from tripleweave.plans import access, metrics
from tripleweave.plans.paths import P
from tripleweave.plans.pattern import match
from tripleweave.sources import scratch
from tripleweave.sources import store as store_module
from tripleweave.sources.store import Store
from tripleweave.sources.triples import PropertyTables

rng = random.Random(7)
# A third of all rows share one subject, another third one object.
TRIPLES = (
    [("hot", "p", f"o{rng.randrange(40)}") for _ in range(150)]
    + [(f"s{rng.randrange(60)}", "p", "big") for _ in range(150)]
    + [(f"s{rng.randrange(60)}", rng.choice("pqrt"), f"o{rng.randrange(40)}") for _ in range(150)]
    + [(f"o{rng.randrange(40)}", "r", f"s{rng.randrange(60)}") for _ in range(30)]
)
PATTERNS = [
    ["p_TRPS", "q_TRPS"],
    ["p_TRPO", "r_TRPS"],
    ["p_TRPS", "q_TRPS", "r_TRPO"],
    ["p_TRPS", "p_TRPO"],
    ["q_TRPS", "p_TRPS"],  # the first one again
]


def side(prop, s):
    return {t[0] if s == "TRPS" else t[2] for t in TRIPLES if t[1] == prop}


def expected_flags(prop, patterns):
    out = {}
    for items in patterns:
        name, head, members = red.canonical(prop, items)
        sets = [side(*red.split_item(m)) for m in members]
        rows = [
            (s, o, True if all((s if head == "TRPS" else o) in x for x in sets) else None)
            for s, p, o in TRIPLES
            if p == prop
        ]
        out[name] = sorted(rows, key=repr)
    return out


@pytest.fixture(scope="module")
def source(frame):
    return frame(TRIPLES).repartition(3)


@pytest.fixture(scope="module")
def store(source, tmp_path_factory):
    return Store.build(source, str(tmp_path_factory.mktemp("store")))


def test_canonical_names():
    assert red.canonical("p", ["q_TRPS", "p_TRPO", "p_TRPS"]) == (
        "p_TRPS_JOIN_p_TRPO_JOIN_q_TRPS", "TRPS", ["p_TRPO", "q_TRPS"],
    )
    assert red.canonical("p", ["q_TRPS", "p_TRPO"])[1] == "TRPO"
    with pytest.raises(ValueError):
        red.canonical("p", ["q_TRPS"])


def test_exact_flags(source):
    flags = red.pattern_flags(source, "p", PATTERNS)
    want = expected_flags("p", PATTERNS)
    assert set(flags.columns) == {"sub", "obj", *want}
    rows = flags.collect()
    for name, expected in want.items():
        assert sorted(((r["sub"], r["obj"], r[name]) for r in rows), key=repr) == expected
    counted = {r["pattern"]: r["rows"] for r in red.pattern_stats(flags).collect()}
    assert counted == {name: sum(x[2] is True for x in rows_) for name, rows_ in want.items()}


def test_bloom_flags_cover_exact_ones(source, store):
    exact = red.pattern_flags(source, "p", PATTERNS)
    maybe = red.pattern_flags(source, "p", PATTERNS, store.filters())
    assert set(maybe.columns) == set(exact.columns)
    assert maybe.count() == exact.count()
    for name in exact.columns[2:]:
        kept = exact.where(F.col(name)).select("sub", "obj")
        assert kept.exceptAll(maybe.where(F.col(name)).select("sub", "obj")).count() == 0


def test_bloom_filter_rates(spark):
    members = spark.range(0, 20_000).select(F.concat(F.lit("m"), "id").alias("v"))
    others = spark.range(0, 200_000).select(F.concat(F.lit("x"), "id").alias("v"))
    for fpp in (0.001, 0.01):
        filter_ = red.bloom_build(members, 20_000, fpp)
        assert red.bloom_semi(members, "v", filter_).count() == 20_000
        assert red.bloom_semi(others, "v", filter_).count() <= 2 * fpp * 200_000
        assert filter_.table.count() <= filter_.n_blocks
    assert 14 < bloom.bits_per_value(0.001) < 20


def test_bloom_union_is_the_filter_of_both(spark):
    a = spark.range(0, 500).select(F.col("id").cast("string").alias("v"))
    b = spark.range(300, 900).select(F.col("id").cast("string").alias("v"))
    merged = red.bloom_union([red.bloom_build(a, 1000), red.bloom_build(b, 1000)])
    whole = red.bloom_build(a.union(b), 1000)
    assert sorted(merged.table.collect()) == sorted(whole.table.collect())
    with pytest.raises(ValueError):
        red.bloom_union([merged, red.bloom_build(a, 10_000_000)])


def test_semi_joins_and_pairs(source):
    for left_side in ("TRPS", "TRPO"):
        for right_side in ("TRPS", "TRPO"):
            keys = side("r", right_side)
            want = sorted((s, o) for s, p, o in TRIPLES if p == "p" and (s if left_side == "TRPS" else o) in keys)
            got = red.semi(source, ("p", left_side), ("r", right_side))
            assert sorted(tuple(r) for r in got.collect()) == want
            stat = red.pair_stats(source, [(("p", left_side), ("r", right_side))]).first()
            assert (stat.type, stat["rows"]) == (left_side[-1] + right_side[-1], len(want))


def test_smallest_table(spark):
    rows = [("p", "SS", "q", 5, 10), ("p", "SO", "q", 5, 10), ("p", "OS", "r", 10, 10), ("z", "SS", "q", 9, 10)]
    sizes = spark.createDataFrame(rows, "prop string, type string, other string, rows bigint, vp_rows bigint")
    got = {r.prop: (r.type, r["rows"]) for r in access.smallest_table(sizes).collect()}
    assert got == {"p": ("SO", 5), "z": ("SS", 9)}
    strict = {r.prop: r.type for r in access.smallest_table(sizes, 0.6).collect()}
    assert strict == {"p": "SO", "z": "VP"}


def test_store_round_trip(store, spark):
    assert sorted(tuple(r) for r in store.frame().collect()) == sorted(TRIPLES)
    assert sorted(tuple(r) for r in store.scan("q").collect()) == sorted((s, o) for s, p, o in TRIPLES if p == "q")
    by_prop = {r.prop: r for r in store.stats().collect()}
    assert by_prop["p"]["rows"] == sum(t[1] == "p" for t in TRIPLES)
    assert sum(r.ratio for r in by_prop.values()) == pytest.approx(1)
    plan = store.scan("q")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", plan) and "EqualTo(prop,q)" in plan
    assert sorted(tuple(r) for r in store.scan_any(["q", "r"]).collect()) == sorted((s, o) for s, p, o in TRIPLES if p in "qr")
    once = Store.build(store.frame(), store.path + "-once", dedupe=True)
    assert once.frame().count() == len(set(TRIPLES))
    assert store.db_stats().first().num_triples == len(TRIPLES)


def test_store_in_the_order_rows_come(source, tmp_path):
    st = Store.build(source, str(tmp_path / "as-it-comes"), by_subject=False)
    assert sorted(tuple(r) for r in st.frame().collect()) == sorted(TRIPLES)
    assert sorted(tuple(r) for r in st.scan("q").collect()) == sorted((s, o) for s, p, o in TRIPLES if p == "q")


@pytest.mark.parametrize("mode", ["exact", "bloom"])
def test_reductions_never_change_answers(source, tmp_path, spark, mode):
    st = Store.build(source, str(tmp_path / mode))
    catalog = red.catalog_of(spark, "p", PATTERNS).unionByName(
        red.catalog_of(spark, "r", [["r_TRPS", "p_TRPO"], ["r_TRPO", "q_TRPS"]])
    )
    st.add_reductions(catalog, mode)
    st.add_reductions(catalog, mode)  # nothing to add the second time
    assert st.patterns().count() == 6
    kept = {r.pattern: r["rows"] for r in st.patterns().where("prop = 'p'").collect()}
    exact = {name: sum(x[2] is True for x in rows) for name, rows in expected_flags("p", PATTERNS).items()}
    assert kept.keys() == exact.keys()
    assert all(kept[n] == exact[n] if mode == "exact" else kept[n] >= exact[n] for n in exact)

    for group in (
        [("?x", "p", "?y"), ("?x", "q", "?z")],
        [("?x", "p", "?y"), ("?y", "r", "?z")],
        [("?x", "p", "?y"), ("?x", "q", "?z"), ("?w", "r", "?x")],
        [("?x", "p", "?y"), ("?y", "p", "?z")],
    ):
        plain, reduced = match(st, group).df, match(st, group, st.reductions()).df
        columns = sorted(plain.columns)
        assert sorted(map(str, reduced.select(columns).collect())) == sorted(map(str, plain.select(columns).collect()))

    choice = st.reductions().choose([("0", "p", "TRPS", ["p_TRPS", "q_TRPS", "r_TRPO"])])
    best = min(v for n, v in kept.items() if n.startswith("p_TRPS") and "p_TRPO" not in n)
    assert choice["0"].rows == best
    assert st.reductions().choose([("0", "p", "TRPS", ["p_TRPS", "t_TRPS"])]) == {}
    assert "LessThanOrEqual(class" in st.reduced_scan("p", choice["0"])._jdf.queryExecution().toString()

    outer = match(st, [("?x", "p", "?y")], st.reductions()).optional(match(st, [("?x", "q", "?z")], st.reductions()))
    assert outer.df.where("z is null").count() > 0
    entry = st.reduced_tables().where("prop = 'p'").first()
    assert entry.members == ["p", "q", "r"] and entry["rows"] == sum(t[1] == "p" for t in TRIPLES)
    assert st.db_stats().first().num_reduced_tables == 2


@pytest.mark.parametrize("mode", ["exact", "bloom"])
def test_patterns_are_tested_once_per_set_of_items(source, store, spark, mode):
    # Of the 70 others each is a word apart; the last patterns ask nothing of what only r asks for.
    others = [f"x{i}_TRPS" for i in range(70)]
    catalog = red.catalog_of(spark, "p", [*PATTERNS, ["p_TRPS", "q_TRPS", *others]]).unionByName(red.catalog_of(spark, "r", [["r_TRPS", "t_TRPO"]]))
    names, filters = red.asked_names(catalog), store.filters() if mode == "bloom" else None
    found = red.occurrences(source, catalog, names, filters)
    assert sorted((r["sub"], r.prop, r.obj) for r in found.collect()) == sorted(t for t in TRIPLES if t[1] in "pr")
    counted = red.signed(red.have_counts(found), catalog, names)
    rows = [(r.prop, tuple(r.sig), r["rows"]) for r in counted.collect()]
    # q, r's objects, p's objects, and r's subjects of the objects: at most that many sets, however many rows.
    assert len([r for r in rows if r[0] == "p"]) <= 16 and len([r for r in rows if r[0] == "r"]) <= 2
    each, classes = {}, {}
    for r in red.signatures(source, catalog, filters).collect():
        each[r.prop, tuple(r.sig)] = each.get((r.prop, tuple(r.sig)), 0) + 1
    for r in red.class_counts(counted).collect():
        classes[r.prop, tuple(r.sig)] = r["rows"]
    assert classes == each and sum(each.values()) == sum(t[1] in "pr" for t in TRIPLES)


def test_compact_table_splits_hot_subjects(source):
    pairs = source.where("prop = 'p'").select("sub", "obj")
    want = {}
    for s, p, o in TRIPLES:
        if p == "p":
            want.setdefault(s, []).append(o)
    whole = {r["sub"]: (r.part, r.objs) for r in layouts.compact_table(pairs).collect()}
    assert whole == {s: (0, sorted(objs)) for s, objs in want.items()}
    got = {}
    rows = layouts.compact_table(pairs, width=4).collect()
    for r in rows:
        got.setdefault(r["sub"], []).extend(r.objs)
    assert {s: sorted(o) for s, o in got.items()} == {s: sorted(o) for s, o in want.items()}
    sizes = [len(r.objs) for r in rows if r["sub"] == "hot"]
    assert len(sizes) > 20 and statistics.mean(sizes) < 8
    counted = {(r["sub"], r.obj): r.n for r in layouts.counted_table(pairs).collect()}
    assert sum(counted.values()) == sum(map(len, want.values())) and all(len(want[s]) >= n for (s, _), n in counted.items())


def test_wide_table_is_a_full_outer_join(source):
    tables = {p: source.where(F.col("prop") == p).select("sub", "obj") for p in "pqr"}
    full = tables["p"].select("sub", F.col("obj").alias("p"))
    for p in "qr":
        full = full.join(tables[p].select("sub", F.col("obj").alias(p)), "sub", "full")
    assert sorted(map(str, layouts.wide_table(tables).collect())) == sorted(map(str, full.collect()))


def test_statistics(source):
    counts = {r.prop: r for r in stats.vp_stats(source).collect()}
    assert counts["q"]["rows"] == sum(t[1] == "q" for t in TRIPLES)
    assert counts["q"].ratio == pytest.approx(counts["q"]["rows"] / len(TRIPLES))
    whole = stats.db_stats(stats.vp_stats(source)).first()
    assert (whole.num_triples, whole.num_properties) == (len(TRIPLES), len(counts))
    assert {r.prop for r in stats.distinct_properties(source).collect()} == set(counts)


def test_report(spark, source, tmp_path):
    st = Store.build(source, str(tmp_path / "r"))
    st.add_reductions(red.catalog_of(spark, "p", PATTERNS))
    needs = spark.createDataFrame([("a", "p", "TRPS", ["p_TRPS", "q_TRPS"])], access.NEEDS)
    scans = spark.createDataFrame([("1", "a", "p"), ("1", "b", "q"), ("2", "c", "none")], "query_id string, scan_id string, prop string")
    got = {r.query_id: r for r in access.reduction_report(scans, needs, st.patterns(), st.stats()).collect()}
    n = {p: sum(t[1] == p for t in TRIPLES) for p in "pq"}
    best = len([1 for s, p, o in TRIPLES if p == "p" and s in side("q", "TRPS")])
    assert (got["1"].vp_rows, got["1"].reduced_rows) == (n["p"] + n["q"], best + n["q"])
    assert (got["2"].vp_rows, got["2"].ratio) == (0, None)


def files_of(spark, path, prop):
    """How many files hold the folder of a property."""
    number = spark.range(1).select(store_module.bucket(F.lit(prop))).first()[0]
    return len(list((path / "triples" / "batch=0" / f"bucket={number}").glob("*.parquet")))


def test_hot_property_is_split_over_files(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.lit("one subject").alias("sub"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 20).cast("string"))).alias("prop"),
        F.concat(F.lit("o"), "id").alias("obj"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "10KB")
    try:
        st = Store.build(rows, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert files_of(spark, tmp_path / "s", "hot") >= 4  # four reducers here
    assert st.frame().count() == 60_000


def test_rare_properties_stay_in_few_files(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 6).select(
        F.col("id").cast("string").alias("sub"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 20).cast("string"))).alias("prop"),
        F.lit("same").alias("obj"),
    )
    Store.build(rows, str(tmp_path / "s"))
    assert all(files_of(spark, tmp_path / "s", f"p{i}") == 1 for i in range(20) if i % 3)


def test_any_property_can_be_stored(spark, tmp_path):
    long = "x" * 300 + "/é:?*"
    rows = [("a", long, "1"), ("b", "", "2"), ("c", "..", "3"), ("d", None, "4"), ("e", "p=q/r", "5")]
    st = Store.build(spark.createDataFrame(rows, "sub string, prop string, obj string"), str(tmp_path / "any"))
    assert sorted(map(str, st.frame().collect())) == sorted(map(str, spark.createDataFrame(rows, st.frame().schema).collect()))
    for sub, prop, obj in rows:
        if prop is not None:
            assert [tuple(r) for r in st.scan(prop).collect()] == [(sub, obj)]
    st.add_reductions(red.catalog_of(spark, "", [["_TRPS", f"{long}_TRPO"]]))
    assert st.patterns().first()["rows"] == 0


def test_ten_thousand_properties_take_as_many_jobs_and_folders_as_ten(spark, tmp_path):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"build-{n}", "")
        rows = spark.range(0, 20_000).select(
            F.col("id").cast("string").alias("sub"), F.concat(F.lit("p"), (F.col("id") % n).cast("string")).alias("prop"), F.lit("o").alias("obj")
        )
        st = Store.build(rows, str(tmp_path / f"many-{n}"))
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{n}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return st, len(ids)

    few, many = jobs(10), jobs(10_000)
    assert abs(few[1] - many[1]) <= 3  # adaptive plans vary by a stage or two
    assert len(list((tmp_path / "many-10000" / "triples" / "batch=0").glob("bucket=*"))) <= store_module.BUCKETS
    assert many[0].scan("p77").count() == 2 and many[0].stats().count() == 10_000


def test_the_input_is_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame(TRIPLES, "sub string, prop string, obj string").mapInPandas(count, "sub string, prop string, obj string")
    st = Store.build(rows, str(tmp_path / "once"))
    assert seen.value == len(TRIPLES) == st.db_stats().first().num_triples
    assert Store(spark, st.path).frame().count() == len(TRIPLES)


def test_filters_are_built_when_asked_for(frame, spark, tmp_path):
    st = Store.build(frame(TRIPLES), str(tmp_path / "asked"))
    held = lambda: {r.prop for r in spark.read.parquet(f"{st.path}/filters").select("prop").distinct().collect()}
    assert held() == set()
    found = st.frame_of(["p"]).select("sub").distinct()
    one = st.filter("q", "TRPS")
    assert held() == {"q"} and red.bloom_semi(st.scan("q"), "sub", one).count() == st.scan("q").count()
    st.add_reductions(red.catalog_of(spark, "p", [["p_TRPS", "r_TRPO"]]), "bloom")
    assert held() == {"q", "r"}
    # A run that was cut short before its properties were noted counts for nothing.
    spark.read.parquet(f"{st.path}/filters").withColumn("run", F.lit("cut")).write.mode("append").parquet(f"{st.path}/filters")
    table = st.filters().table
    assert held() == {"p", "q", "r", "t"} and table.count() == table.dropDuplicates(["prop", "side", "block"]).count()
    assert red.bloom_semi(found, "sub", st.filter("p", "TRPS")).count() == found.count()


def test_appending_merges_statistics_and_voids_reductions(frame, spark, tmp_path):
    half = len(TRIPLES) // 2
    st = Store.build(frame(TRIPLES[:half]), str(tmp_path / "grows"))
    st.add_reductions(red.catalog_of(spark, "p", PATTERNS))
    stale = Store(spark, st.path)
    grown = st.append(frame(TRIPLES[half:]))
    whole = Store.build(frame(TRIPLES), str(tmp_path / "whole"))
    columns = ["prop", "rows", "subjects", "objects"]
    assert sorted(map(str, grown.stats().select(columns).collect())) == sorted(map(str, whole.stats().select(columns).collect()))
    assert sorted(map(str, grown.filters().table.collect())) == sorted(map(str, whole.filters().table.collect()))
    assert grown.patterns().count() == 0 and grown.rows(["p"]) == whole.rows(["p"])
    assert sorted(map(str, grown.frame().collect())) == sorted(map(str, whole.frame().collect()))
    assert stale.frame().count() == half  # opened before the append
    # What an append that was cut short has written does not count, and the next one writes over it.
    frame([("stray", "p", "x")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{st.path}/triples/batch=2")
    assert Store(spark, st.path).frame().count() == len(TRIPLES)
    again = Store(spark, st.path).append(frame([TRIPLES[0], TRIPLES[0], ("new", "p", "y"), ("new", "p", "y")]), dedupe=True)
    assert again.frame().count() == len(TRIPLES) + 1 and again.scan("p").where("sub = 'stray'").count() == 0


# All sets of two to eight of these give 247 patterns of "p".
WIDE = [f"q{i}" for i in range(8)]


@pytest.fixture(scope="module")
def wide(spark):
    """60,000 subjects of p; each other property holds a share of them."""
    subjects = spark.range(0, 60_000)
    rows = subjects.select(F.concat(F.lit("s"), "id").alias("sub"), F.lit("p").alias("prop"), F.lit("o").alias("obj"))
    for i, prop in enumerate(WIDE):
        kept = subjects.where(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2 + 3 * i)) == 0)
        rows = rows.union(kept.select(F.concat(F.lit("s"), "id"), F.lit(prop), F.lit("o")))
    return rows


def test_every_pattern_is_stored_and_scans_decode_little_else(spark, wide, tmp_path):
    patterns = [["p_TRPS", *[f"{q}_TRPS" for i, q in enumerate(WIDE) if n >> i & 1]] for n in range(1, 256)]
    st = Store.build(wide, str(tmp_path / "wide"))
    st.add_reductions(red.catalog_of(spark, "p", patterns))
    kept = {r.pattern: r for r in st.patterns().collect()}
    assert len(kept) == 255 and sorted(r.slot for r in kept.values()) == list(range(255))
    assert [r["size"] for r in sorted(kept.values(), key=lambda r: r.slot)] == sorted(r["size"] for r in kept.values())
    for n in (1, 3, 128, 129, 240):  # among them slots beyond one word and beyond 100
        chosen = [q for i, q in enumerate(WIDE) if n >> i & 1]
        group = [("?s", "p", "?o"), *[("?s", q, f"?{q}") for q in chosen]]
        answer = match(st, group, st.reductions())
        expected = match(st, group).df.count()
        choice = st.reductions().choose([("0", "p", "TRPS", ["p_TRPS", *[f"{q}_TRPS" for q in chosen]])])["0"]
        assert answer.df.count() == expected == choice.rows
        scan = st.reduced_scan("p", choice)
        assert scan.count() == choice.rows
        # Pages are the least that is decoded: one at each end of a range.
        assert metrics.rows_scanned(scan) <= choice.rows + 2 * store_module.PAGE_ROWS * len(choice.ranges)
    pairs = [kept[f"p_TRPS_JOIN_{q}_TRPS"] for q in reversed(WIDE)]  # the rarest first
    assert [len(r.ranges) <= 2**i for i, r in enumerate(pairs)] == [True] * 8


def test_patterns_in_many_ranges_read_the_classes(spark, wide, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "LISTED_RANGES", 0)
    st = Store.build(wide, str(tmp_path / "ranges"))
    st.add_reductions(red.catalog_of(spark, "p", [["p_TRPS", "q0_TRPS"], ["p_TRPS", "q1_TRPS"], ["p_TRPS", "q0_TRPS", "q1_TRPS"]]))
    rows = st.patterns().collect()
    assert all(r.ranges is None for r in rows)
    for r in rows:
        assert st.reduced_scan("p", access.Choice(r.run, r.slot, r["rows"], None)).count() == r["rows"]


def test_bloom_reductions_take_the_same_jobs_for_many_items(spark, wide, tmp_path):
    st = Store.build(wide, str(tmp_path / "bloom"))

    def jobs(prop, items):
        spark.sparkContext.setJobGroup(f"reduce-{prop}", "")
        st.add_reductions(red.catalog_of(spark, prop, [[f"{prop}_TRPS", i] for i in items]), "bloom")
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(f"reduce-{prop}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(ids)

    assert abs(jobs("q7", ["p_TRPS"]) - jobs("p", [f"{q}_TRPS" for q in WIDE])) <= 10  # stages of adaptive plans
    exact = {q: st.scan(q).count() for q in WIDE}
    for r in st.patterns().where("prop = 'p'").collect():
        n = exact[red.split_item(r.members[0])[0]]
        assert n <= r["rows"] <= n + 60_000 * 2 * red.FPP


def test_long_name_lists_join_instead(source, monkeypatch, spark):
    want = sorted(map(str, red.pattern_flags(source, "p", PATTERNS).collect()))
    monkeypatch.setattr(red, "PUSHED_VALUES", 0)
    monkeypatch.setattr(red, "BROADCAST_ROWS", 0)
    assert sorted(map(str, red.pattern_flags(source, "p", PATTERNS).collect())) == want


def test_rebuilding_voids_old_reductions(source, frame, tmp_path, spark):
    path = str(tmp_path / "again")
    st = Store.build(source, path)
    st.add_reductions(red.catalog_of(spark, "p", [["p_TRPS", "q_TRPS"]]))
    st = Store.build(frame([("x", "p", "y"), ("x", "q", "z"), ("w", "q", "z")]), path)
    group = [("?a", "p", "?b"), ("?a", "q", "?c")]
    assert [tuple(r) for r in match(st, group, st.reductions()).project("?a", "?b", "?c").df.collect()] == [("x", "y", "z")]
    assert st.patterns().count() == 0
    st.add_reductions(red.catalog_of(spark, "q", [["q_TRPS", "p_TRPS"]]))
    assert st.reductions().choose([("0", "q", "TRPS", ["p_TRPS", "q_TRPS"])])["0"].rows == 1


def test_unknown_properties_match_nothing(source, spark):
    assert match(source, [("?a", "none", "?b")]).df.count() == 0
    tables = PropertyTables({"p": lambda: source.where("prop = 'p'").select("sub", "obj")})
    assert match(tables, [("?a", "none", "?b")]).df.count() == 0


def test_scratch_folder(spark, monkeypatch):
    monkeypatch.setattr(scratch, "SETTING", "spark.no.such.dir")
    folder = scratch.shared_folder(spark)
    assert folder.startswith("/tmp/run-") and scratch.shared_folder(spark) == folder
    assert scratch.new_path(spark, "x").startswith(folder + "/x-")


def test_many_items_take_several_words_and_jobs(source, monkeypatch, spark, tmp_path):
    want = sorted(map(str, red.pattern_flags(source, "p", PATTERNS).collect()))
    monkeypatch.setattr(red, "WORD_BITS", 2)
    assert sorted(map(str, red.pattern_flags(source, "p", PATTERNS).collect())) == want
    monkeypatch.setattr(store_module, "JOB_ITEMS", 1)
    st = Store.build(source, str(tmp_path / "jobs"))
    catalog = red.catalog_of(spark, "p", PATTERNS).unionByName(red.catalog_of(spark, "r", [["r_TRPS", "p_TRPO"]]))
    assert st._jobs(catalog) == [["p"], ["r"]]
    st.add_reductions(catalog)
    got = {r.pattern: r["rows"] for r in st.patterns().where("prop = 'p'").collect()}
    assert got == {n: sum(x[2] is True for x in rows) for n, rows in expected_flags("p", PATTERNS).items()}
    assert st.patterns().where("prop = 'r'").count() == 1


def test_outer_items_reduce_optional_parts_and_union_arms_only(source, tmp_path, spark):
    st = Store.build(source, str(tmp_path / "outer"))
    st.add_reductions(red.catalog_of(spark, "p", PATTERNS).unionByName(red.catalog_of(spark, "r", [["r_TRPO", "q_TRPS"]])))
    use = st.reductions()

    def rows(pattern):
        return sorted(map(str, pattern.df.select(sorted(pattern.df.columns)).collect()))

    def reduced(pattern):
        return "/reduced/" in pattern.df._jdf.queryExecution().optimizedPlan().toString() or any("/reduced/" in f for f in pattern.df.inputFiles())

    plain = lambda *group: match(st, list(group))
    left = match(st, [("?x", "q", "?z")], use)
    inside = match(st, [("?x", "p", "?y")], use, outer=left)
    assert reduced(inside) and inside.assumes == {"x": {"q_TRPS"}}
    assert rows(left.optional(inside)) == rows(plain(("?x", "q", "?z")).optional(plain(("?x", "p", "?y"))))
    arm = match(st, [("?w", "r", "?x")], use, outer=left)
    want = plain(("?x", "q", "?z")).join(plain(("?x", "p", "?y")).union(plain(("?w", "r", "?x"))))
    assert reduced(arm) and rows(left.join(inside.union(arm))) == rows(want)
    assert rows(inside.join(left)) == rows(plain(("?x", "p", "?y"), ("?x", "q", "?z")))
    # Never out of an optional part: the outer scan is whole, and keeps the rows without a partner.
    outside = match(st, [("?x", "p", "?y")], use)
    assert not reduced(outside)
    both = outside.optional(match(st, [("?x", "q", "?z")], use, outer=outside))
    assert rows(both) == rows(plain(("?x", "p", "?y")).optional(plain(("?x", "q", "?z"))))
    assert both.df.where("z is null").count() > 0
    # And a reduced part is not joined to a pattern that does not keep what it was told.
    for other in (outside, match(st, [("?w", "r", "?x")], use)):
        with pytest.raises(ValueError):
            other.optional(inside)
        with pytest.raises(ValueError):
            other.join(inside.union(arm))
    with pytest.raises(ValueError):
        inside.project("?y")


def test_paths_read_reduced_tables(source, tmp_path, spark):
    st = Store.build(source, str(tmp_path / "paths"))
    st.add_reductions(red.catalog_of(spark, "p", [["p_TRPO", "r_TRPS"]]))
    group = [("?a", P("p") / P("r"), "?b")]
    answer = match(st, group, st.reductions())
    assert any("/reduced/" in f for f in answer.df.inputFiles())
    assert sorted(map(str, answer.df.collect())) == sorted(map(str, match(st, group).df.collect()))
