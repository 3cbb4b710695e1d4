import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleweave.functions import prefixes
from tripleweave.operators import embedding
from tripleweave.operators import reductions as red
from tripleweave.operators import workload as w

LOG = [
    (1, "?x", "p", "?y"),
    (1, "?x", "q", "?z"),
    (1, "?z", "r", "?w"),
    (2, "?x", "p", "?y"),
    (2, "?x", "p", "?z"),
    (2, "?x", "?any", "?y"),
    (3, "?a", "p", "?b"),
    (3, "?b", "q", "?c"),
    (3, "?b", "r", '"lit"'),
    (4, "?s", "q", "?t"),
    (5, "?x", "p", "?y"),
    (5, "?x", "q", "?y"),
]
JOINS = {
    (1, "x"): Counter(["p_TRPS", "q_TRPS"]),
    (1, "z"): Counter(["q_TRPO", "r_TRPS"]),
    (2, "x"): Counter(["p_TRPS", "p_TRPS"]),
    (2, "y"): Counter(["p_TRPO"]),
    (3, "b"): Counter(["p_TRPO", "q_TRPS", "r_TRPS"]),
    (5, "x"): Counter(["p_TRPS", "q_TRPS"]),
    (5, "y"): Counter(["p_TRPO", "q_TRPO"]),
}


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, "query_id int, sub string, prop string, obj string")


@pytest.fixture(scope="module")
def txns(log):
    return w.transactions(w.join_patterns(log))


def test_join_patterns_and_transactions(log, txns):
    got = defaultdict(Counter)
    for r in w.join_patterns(log).collect():
        got[r.query_id, r["var"]][r.item] += r.n
    assert got == JOINS
    # length is tested before repeats go: (2, x) stays as a single item, (2, y) does not
    want = {k: sorted(set(c)) for k, c in JOINS.items() if sum(c.values()) > 1}
    assert {(r.query_id, r["var"]): r["items"] for r in txns.collect()} == want


def test_frequencies(log, spark):
    assert [(r.prop, r.freq) for r in w.property_freq(log).collect()] == [("p", 5), ("q", 4), ("r", 2)]
    stored = spark.createDataFrame([("q",), ("z",)], "prop string")
    assert [r.prop for r in w.property_freq(log, stored).collect()] == ["q"]
    assert {(r.query_id, r.prop): r.n for r in w.query_properties(log).collect()}[2, "p"] == 2
    assert w.count_queries(log.select("query_id").distinct()).first().queries == 5


def itemsets(min_count=1):
    counts = Counter()
    for c in JOINS.values():
        if sum(c.values()) > 1:
            items = sorted(set(c))
            for k in range(2, len(items) + 1):
                counts.update(combinations(items, k))
    return {k: v for k, v in counts.items() if v >= min_count}


def test_frequent_itemsets(txns):
    got = {tuple(r["items"]): r.freq for r in w.frequent(txns, 0.0).collect()}
    assert got == itemsets()
    assert {tuple(r["items"]) for r in w.frequent(txns, 0.3).collect()} == set(itemsets(2))


def cost(items, freq, alpha, nq, np_):
    support = math.log(freq) / math.log(nq) if nq > 1 else 0
    return round(alpha * support + (1 - alpha) * (math.log(len(items)) / math.log(np_) if np_ > 1 else 0), 9)


@pytest.mark.parametrize("alpha,nq,n_props", [(0.5, 5, 3), (0.1, 5, 3), (1.0, 5, 3), (0.5, 1, 1)])
def test_cost_model_and_fp_proposals(txns, alpha, nq, n_props):
    best = w.best_by_cost(w.frequent(txns, 0.0), nq, n_props, alpha)
    want = {}
    for items, freq in itemsets().items():
        c = cost(items, freq, alpha, nq, n_props)
        for item in items:
            if c > 0:
                want[item] = min(want.get(item, (math.inf,)), (-c, -freq, items))
    got = {r.item: (-r.cost, -r.freq, tuple(r["items"])) for r in best.collect()}
    assert got == want
    per_prop = {}
    for item, key in want.items():
        p = item.rsplit("_", 1)[0]
        per_prop[p] = min(per_prop.get(p, (math.inf,)), key)
    members = {p: sorted({i.rsplit("_", 1)[0] for i in key[2]}) for p, key in per_prop.items()}
    assert {r.prop: r.members for r in w.propose_fp(best).collect()} == members


def test_cooccurrence_and_evaluation(txns, spark):
    proposals = {r.prop: r.members for r in w.propose_cooccurrence(txns).collect()}
    assert proposals == {"p": ["p", "q", "r"], "q": ["p", "q", "r"], "r": ["p", "q", "r"]}
    predicted = spark.createDataFrame([("p", ["p", "q"]), ("q", ["x"]), ("only", ["a"])], "prop string, members array<string>")
    gold = spark.createDataFrame([("p", ["p", "q", "r", "s"]), ("q", ["q"]), ("z", ["z"])], "prop string, members array<string>")
    scores = {r.prop: (r.precision, r.recall, r.f1) for r in w.evaluate(predicted, gold).collect()}
    assert scores == {"p": (1.0, 0.5, pytest.approx(2 / 3)), "q": (0.0, 0.0, 0.0)}
    assert w.mean_f1(w.evaluate(predicted, gold)).first().f1 == pytest.approx(1 / 3)


def test_matching_patterns_and_slots(txns, spark):
    proposals = spark.createDataFrame([("p", ["p", "q"]), ("r", ["q"])], "prop string, members array<string>")
    got = w.matching_patterns(w.frequent(txns, 0.0), proposals)
    want = set()
    for items in itemsets():
        for prop, members in (("p", {"p", "q"}), ("r", {"q", "r"})):
            kept = [i for i in items if i.rsplit("_", 1)[0] in members]
            if any(i.startswith(prop + "_") for i in items) and len(kept) > 1:
                name, head, rest = red.canonical(prop, kept)
                want.add((prop, name, head, tuple(rest), len(kept)))
    assert {(r.prop, r.pattern, r["head"], tuple(r.members), r.size) for r in got.collect()} == want
    slots = red.number_slots(got).where("prop = 'p'").orderBy("slot").collect()
    names = sorted((x[4], x[1]) for x in want if x[0] == "p")
    assert [(r.size, r.pattern) for r in slots] == names and [r.slot for r in slots] == list(range(len(names)))


def test_patterns_from_query_text(spark):
    query = """BASE <http://dbpedia.org/resource/>
    PREFIX o: <http://dbpedia.org/ontology/> PREFIX : <http://x/>
    SELECT ?a ?b ?c WHERE { ?a o:country <Berlin> . $a a o:City .
      OPTIONAL { ?a <http://dbpedia.org/ontology/name> "a b . c"@en } { ?b :p ?c } UNION { ?c rdf:q 5 }
      FILTER (?c > 5) FILTER regex(?b, "x y z") } ORDER BY ?a ?b ?c"""
    df = spark.createDataFrame([(1, query), (2, "no query")], "query_id int, query string")
    got = [tuple(r)[1:] for r in w.triple_patterns(df, prefixes.DBPEDIA).collect()]
    assert got == [
        ("?a", "dbo__country", "dbr__Berlin"),
        ("?a", "rdf__type", "dbo__City"),
        ("?a", "dbo__name", '"a b . c"@en'),
        ("?b", "http://x/p", "?c"),
        ("?c", "rdf:q", "5"),
    ]


def test_lists_in_queries(spark):
    text = """PREFIX e: <http://e/> SELECT * WHERE { ?a e:p ?b ; e:q ?c , ?d . ?d e:r 'v' .
        OPTIONAL { ?d a e:T ; e:s '''l"o''' } FILTER(?x > 5 && regex(?c, 'a', 'i'))
        { SELECT ?x ?y ?z WHERE { ?x e:k/e:l ?z . ?x e:m "a ; b , c ."@en, 5.5 ; . } }
        VALUES ?v { e:a e:b e:c } ?v e:w e:z }"""
    df = spark.createDataFrame([(1, text), (2, ""), (3, "{}"), (4, None)], "query_id int, query string")
    assert [tuple(r) for r in w.triple_patterns(df, {}).collect()] == [
        (1, "?a", "http://e/p", "?b"),
        (1, "?a", "http://e/q", "?c"),
        (1, "?a", "http://e/q", "?d"),
        (1, "?d", "http://e/r", '"v"'),
        (1, "?d", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"),
        (1, "?d", "http://e/s", r'"l\"o"'),
        (1, "?x", "http://e/m", '"a ; b , c ."@en'),
        (1, "?x", "http://e/m", "5.5"),
        (1, "?v", "http://e/w", "http://e/z"),
    ]


def test_embeddings(spark, log, monkeypatch):
    words = {r.query_id: r.words for r in embedding.sentences(log).collect()}
    assert words == {1: ["p", "q", "r"], 2: ["p"], 3: ["p", "q", "r"], 5: ["p", "q"]}
    vectors = embedding.learn(embedding.sentences(log), vector_size=4)
    assert {r.prop for r in vectors.collect()} == {"p", "q", "r"}

    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 6))
    m[7] = m[3]
    names = [f"v{i:02}" for i in range(40)]
    df = spark.createDataFrame(
        [(n, [float(x) for x in v]) for n, v in zip(names, m)], "prop string, vector array<float>"
    )
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    for block in (50_000, 500):
        monkeypatch.setattr(embedding, "BLOCK", block)
        got = defaultdict(set)
        for r in embedding.nearest(df, 5).collect():
            got[r.prop].add(r.other)
        for i, n in enumerate(names):
            order = [names[j] for j in np.argsort(-cos[i], kind="stable") if j != i][:5]
            assert got[n] == set(order)
    proposals = {r.prop: r.members for r in embedding.propose_embedding(df, 5).collect()}
    assert len(proposals) == 40 and all(p in mem and len(mem) == 6 for p, mem in proposals.items())
    ranked = [r.prop for r in embedding.similar_to(df, "v03", 0.5).collect()]
    assert ranked[:2] == ["v03", "v07"]
    assert set(ranked) == {names[j] for j in range(40) if cos[3][j] > 0.5}
    assert embedding.similar_to(df, "none").count() == 0


def test_transactions_in_one_shuffle(log, spark):
    odd = [(6, "?x", None, "?y"), (6, "?x", "p", None), (6, "?x", "?p", "?x"), (None, "?n", "p", "?n"), (7, "?x", "p", "?x")]
    patterns = log.unionByName(spark.createDataFrame(odd, log.schema))
    rows = lambda df: sorted((str(r.query_id), r["var"], tuple(r["items"])) for r in df.collect())
    want = rows(w.transactions(w.join_patterns(patterns)))
    for n in (None, 0, 10**7):
        mined = w.mined_transactions(patterns, n)
        assert rows(mined) == want
        assert "keys=[query_id" in (plan := mined._jdf.queryExecution().sparkPlan().toString()) and "Window" not in plan
    # By rows known, tasks hold a bounded number of patterns whatever the session's setting.
    assert w.mined_transactions(patterns, 5 * w.TASK_ROWS + 1).rdd.getNumPartitions() == 6


def test_evaluation_in_long_form(txns, spark):
    """No row holds the members of a property, and the scores are those of the lists."""
    old, new = txns.where("query_id < 3"), txns.where("query_id >= 2")
    want = {r.prop: (r.precision, r.recall, r.f1) for r in w.evaluate(w.propose_cooccurrence(old), w.propose_cooccurrence(new)).collect()}
    both = old.withColumn("actual", F.lit(False)).unionByName(new.withColumn("actual", F.lit(True)))
    pairs = w.cooccurring(both, "actual")
    assert {r.prop: (r.precision, r.recall, r.f1) for r in w.evaluate_pairs(pairs, F.col("actual")).collect()} == want
    assert pairs.columns == ["actual", "prop", "other"] and pairs.count() == pairs.distinct().count()


@pytest.mark.parametrize("support", [0.0, 0.02, 0.2, 1.0])
def test_itemsets_of_repeated_transactions(spark, support):
    """Repeats are counted, not mined again, and the itemsets are those of a plain count."""
    rng = np.random.default_rng(5)
    sets = [sorted({f"i{x}" for x in rng.zipf(1.6, rng.integers(0, 7)) if x < 12}) for _ in range(60)]
    rows = [s for s in sets for _ in range(5)] + [None]
    txns = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    assert w.item_sets(txns).count() == len({tuple(s) for s in sets})
    counts = Counter(c for s in sets for k in range(2, len(s) + 1) for c in combinations(s, k))
    least = math.ceil(support * 300)
    got = {tuple(r["items"]): (r.freq, r["size"]) for r in w.frequent(txns, support).collect()}
    assert got == {c: (5 * n, len(c)) for c, n in counts.items() if 5 * n >= least}
    assert w.frequent(txns.where("items is null"), support).count() == 0


def plain_triples(tokens):
    """The triples of a list of tokens, by the rules of query text, one token after the other."""
    sub = prop = None
    full, until, found = False, "", []
    for t in tokens:
        literal = t[0] in "\"'" and len(t) > 1
        node = len(t) > 1 and (t[0] in "?$<" or (":" in t and not literal))
        value = node or literal or t.lstrip("+-")[:1].isdigit()
        if until and t != until:
            continue
        if t.upper() in ("SELECT", "VALUES"):
            sub, prop, full, until = None, None, False, "{" if t.upper() == "SELECT" else "}"
        elif t == "," and full:
            full = False
        elif t == ";" and (full or (sub and not prop)):
            prop, full = None, False
        elif value and sub and prop and not full:
            found.append((sub, prop, t))
            full = True
        elif (node or t == "a") and sub and not prop:
            prop = t
        elif node and (not sub or full):
            sub, prop, full = t, None, False
        else:
            sub = prop = None
            full, until = False, ""
    return found


def test_tokens_are_looked_at_once(spark):
    words = ["?x", "$y", "<i>", "<>", "e:p", ":q", "-a:b", "a", "A", ",", ";", "{", "}", ".", "5", "-5.5", "+", "select", "VALUES", "Vx", "sel", '"l"@en', "'s'", '"', "é", "?", "<", "_"]
    weights = np.array([8, 2, 3, 1, 6, 1, 1, 2, 1, 4, 4, 1, 1, 3] + [1] * (len(words) - 14), float)
    rng = np.random.default_rng(3)
    rows = [(i, [words[j] for j in rng.choice(len(words), rng.integers(0, 30), p=weights / weights.sum())]) for i in range(400)]
    rows = [(i, [t for t in ts if t != '"' or ts.count('"') < 2]) for i, ts in rows]
    df = spark.createDataFrame([(i, " ".join(ts)) for i, ts in rows], "id int, body string")
    got = {r.id: [tuple(x) for x in r.found] for r in df.select("id", w._written_triples(F.col("body")).alias("found")).collect()}
    split = {r.id: r.t for r in df.select("id", F.regexp_extract_all("body", F.lit(w.TOKEN), F.lit(0)).alias("t")).collect()}
    assert got == {i: plain_triples(ts) for i, ts in split.items()} and sum(map(len, got.values())) > 200


def test_filters_leave_terms_alone(spark):
    """A filter on a mined term does not work the term out again, nested in itself."""
    df = spark.createDataFrame([(1, "SELECT * WHERE { ?a e:p ?b }")], "query_id int, query string")
    plan = w.property_freq(w.triple_patterns(df, {"e": "http://e/"}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_position(") <= 6


def test_queries_are_dealt_over_tasks(spark):
    """A log in one piece is parsed by all tasks, in pieces of a bounded number of queries."""
    log = spark.range(40).coalesce(1).selectExpr("id as query_id", "'SELECT * WHERE { ?a <e:p> ?b }' as query")
    parsed = w.triple_patterns(log, {}, 5 * w.TASK_QUERIES)
    assert parsed.rdd.getNumPartitions() == 5 and parsed.count() == 40
    assert sum(n > 0 for n in parsed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1
    assert w.triple_patterns(log, {}, 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("most", [500, 3])
def test_item_sets_are_mined_by_bits(frame, most, monkeypatch):
    """The item sets of the transactions, over more items than a word has bits, and by sets where the log names too many properties."""
    monkeypatch.setattr(w, "MASKED_PROPS", most)
    pick = random.Random(3)
    terms = ["?a", "?b", "$c", "'x'", "<i>"]
    rows = [(q, pick.choice(terms), pick.choice([f"p{pick.randrange(40)}", "?p", "p0", None]), pick.choice(terms)) for q in range(400) for _ in range(4)]
    rows += [(200, "?a", "p1", "?a"), (201, "?a", "p1", "?b"), (201, "?b", "p1", "?c"), (202, "?a", "p2", "?b"), (202, "?a", "p2", "?b"), (203, None, "p2", "?a")]
    patterns = frame(rows, "query_id int, sub string, prop string, obj string")
    want = {tuple(r["items"]): r.n for r in w.item_sets(w.transactions(w.join_patterns(patterns))).collect()}
    found = w.mined_item_sets(patterns, 1600).collect()
    assert len({i for r in found for i in r["items"]}) > 63 and len(found) == len(want)
    assert {tuple(r["items"]): r.n for r in found} == want
    assert w.mined_item_sets(patterns.where("false")).count() == 0
