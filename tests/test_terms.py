from pyspark.sql import functions as F

from tripleweave.functions import filters as f
from tripleweave.functions import prefixes, terms
from tripleweave.sources import text


def values(df, col="x"):
    return [r[col] for r in df.collect()]


def column(spark, rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i")


def test_compact_longest_namespace_wins(spark):
    rows = [
        "<http://dbpedia.org/resource/Category:Art>",
        "<http://dbpedia.org/resource/Berlin>",
        "<http://be-x-old.dbpedia.org/resource/X>",
        "<http://nowhere.example/x>",
        '"http://dbpedia.org/resource/Berlin"',
        '"5"^^<http://www.w3.org/2001/XMLSchema#int>',
        "yago__plain",
        None,
    ]
    got = values(column(spark, rows).select(terms.compact(F.col("t"), prefixes.DBPEDIA).alias("x")))
    assert got == [
        "dbc__Art",
        "dbr__Berlin",
        "dbpedia-be-x-old__X",
        "http://nowhere.example/x",
        '"http://dbpedia.org/resource/Berlin"',
        '"5"^^<http://www.w3.org/2001/XMLSchema#int>',
        "yago__plain",
        None,
    ]


def test_compact_then_expand_is_identity_for_every_namespace(spark):
    for table in (prefixes.DBPEDIA, prefixes.WATDIV, prefixes.YAGO, prefixes.LUBM):
        rows = [f"<{ns}thing_{i}__x>" for i, ns in enumerate(table.values())] + ['"a b"@en', "_:b1"]
        short = terms.compact(F.col("t"), table)
        df = column(spark, rows).select("t", short.alias("s"), terms.expand(short, table).alias("x"))
        for r in df.collect():
            assert r.x == r.t
            assert r.t[0] != "<" or not r.s.startswith("http")


def test_lexical_lang_numeric(spark):
    rows = ['"a"', '"a"@en-GB', '"12.5"^^<xsd:decimal>', "node/1", '"say "hi""', '"two\nlines"', None, '""']
    df = column(spark, rows)
    t = F.col("t")
    assert values(df.select(terms.lexical(t).alias("x"))) == [
        "a", "a", "12.5", "node/1", 'say "hi"', "two\nlines", None, "",
    ]
    assert values(df.select(terms.lang(t).alias("x"))) == ["", "en-GB", "", "", "", "", None, ""]
    assert values(df.select(terms.numeric(t).alias("x"))) == [None, None, 12.5, None, None, None, None, None]
    spelt = ["7", "-.5", "+1.e2", '"3E-1"', "5d", "0x1p3", "Infinity", "NaN", "1 2", ".", None]
    got = values(column(spark, spelt).select(terms.numeric(t).alias("x")))
    assert got == [7.0, -0.5, 100.0, 0.3, None, None, None, None, None, None, None]


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, '"10"', '"9"'), (2, '"b"@en', '"a"@de-AT'), (3, "n/1", None)], "i int, a string, b string"
    )

    def kept(cond):
        return [r.i for r in df.where(cond).orderBy("i").collect()]

    assert kept(f.compare("?a", ">", 9)) == [1]
    assert kept(f.compare(9, "<=", "?a")) == [1]
    assert kept(f.compare("?a", ">", "?b")) == [1, 2]  # 10 > 9 as numbers, b > a as text
    assert kept(f.compare("?a", "=", '"10"')) == [1]
    assert kept(f.compare("?a", "=", "n/1")) == [3]
    assert kept(f.compare("?a", "!=", "n/1")) == [1, 2]
    assert kept(f.compare("?a", ">=", '"b"')) == [2, 3]
    assert kept(f.bound("?b")) == [1, 2]
    assert kept(f.not_bound("?b") | f.compare("?a", "=", 10)) == [1, 3]
    assert kept(~f.bound("?b") & f.regex("?a", "^N/", "i")) == [3]
    assert kept(f.lang_matches("?b", "de")) == [2]
    assert kept(f.lang_matches("?a", "*")) == [2]
    assert kept(f.lang("?a") == "en") == [2]
    assert kept(f.str_("?a") == "b") == [2]
    assert kept(f.compare(f.add("?a", "?b"), "=", 19)) == [1]
    assert kept(f.compare(f.subtract("?a", 1), "=", "?b")) == [1]


def test_parse_triples(spark):
    lines = spark.createDataFrame(
        [
            ('<http://schema.org/a> <http://schema.org/p> "with several words" .',),
            ("<http://schema.org/a> <http://schema.org/p> <http://schema.org/b>.",),
            ("  a\tp   yago__St.",),
            ("x p y .",),
            ("# comment <a> <b> <c> .",),
            ("",),
            ("only two",),
        ],
        "value string",
    )
    got = {tuple(r) for r in text.parse_triples(lines, None, prefixes.WATDIV).collect()}
    assert got == {
        ("sorg__a", "sorg__p", '"with several words"'),
        ("sorg__a", "sorg__p", "sorg__b"),
        ("a", "p", "yago__St."),
        ("x", "p", "y"),
    }
    assert values(text.rejected(lines), "value") == ["only two"]
    tabbed = spark.createDataFrame([("a b\tp q\tc d .",)], "value string")
    assert [tuple(r) for r in text.parse_triples(tabbed, "\t").collect()] == [("a b", "p q", "c d")]


def test_ends_of_triples(spark):
    good = {
        "<s> <p> <o> . # note": "<o>",
        '<s> <p> "x"@en.': '"x"@en',
        "<s> <p> _:b1.": "_:b1",
        r'<s> <p> "a \"b\" . # c"^^<t> .': r'"a \"b\" . # c"^^<t>',
        f'<s> <p> "{"x" * 50_000}" .': f'"{"x" * 50_000}"',
    }
    bad = ["<s> <p> <o> <g> .", '<s> <p> "open .', "<s> <p> .", '<s> <p> "a" "b" .']
    loose = {"s p o .": "o", "<s> <p> <o>": "<o>"}
    lines = spark.createDataFrame([(x,) for x in [*good, *bad, *loose]], "value string")
    objects = lambda strict: sorted(r.obj for r in text.parse_triples(lines, None, {}, strict).collect())
    bare = lambda terms: sorted(t.strip("<>") if t.startswith("<") else t for t in terms)
    assert bare(objects(False)) == bare([*good.values(), *loose.values()])
    assert bare(objects(True)) == bare(good.values())
    assert sorted(values(text.rejected(lines), "value")) == sorted(bad)
    assert sorted(values(text.rejected(lines, strict=True), "value")) == sorted([*bad, *loose])


def test_clean_jobs(spark, tmp_path):
    nt = spark.createDataFrame(
        [
            ("# dump",),
            ("<http://dbpedia.org/resource/A> <http://dbpedia.org/ontology/p> <http://dbpedia.org/resource/B> .",),
            ('<http://dbpedia.org/resource/A> <http://dbpedia.org/ontology/n> "A b"@en .',),
        ],
        "value string",
    )
    assert values(text.clean_dbpedia(nt), "value") == ["dbr__A dbo__p dbr__B", 'dbr__A dbo__n "A b"@en']
    assert values(text.convert_prefixes(nt, prefixes.YAGO), "value") == [
        "dbr__A dbp__p dbr__B .", 'dbr__A dbp__n "A b"@en .',
    ]
    yago = spark.createDataFrame(
        [
            ("# c",),
            ("@base x",),
            ("<Albert>\trdf:type\t<wordnet_person> .",),
            ("<http://dbpedia.org/resource/A>\tplain\t<x>",),
            ("two\tfields",),
        ],
        "value string",
    )
    cleaned = text.clean_yago(yago)
    assert values(cleaned, "value") == ["yago__Albert rdf__type yago__wordnet_person .", "dbr__A plain yago__x ."]
    text.write_lines(cleaned, str(tmp_path / "out"))
    assert sorted(values(spark.read.text(str(tmp_path / "out")), "value")) == sorted(values(cleaned, "value"))


def test_log_extraction(spark, tmp_path):
    lines = spark.createDataFrame(
        [
            ('1.2.3.4 - - [t] z "GET /sparql?query=SELECT%20?a%20WHERE%20%7B%0A?a+<p>+?b%7D&format=x"',),
            ('1.2.3.4 - - [t] z "GET /sparql?query=SELECT%20?a%20WHERE%20%7B%0A?a+<p>+?b%7D&format=x"',),
            ('1.2.3.4 - - [t] z "GET /other"',),
            ("short",),
        ],
        "value string",
    )
    rows = text.log_queries(lines).collect()
    assert len(rows) == 1
    assert rows[0].query.startswith("PREFIX dbr: <http://dbpedia.org/resource/> PREFIX dbr:")
    assert rows[0].query.endswith("PREFIX soic: <http://rdfs.org/sioc/ns#> SELECT * WHERE { ?a <p> ?b}")

    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "b.txt").write_text("SELECT\n?b")
    (tmp_path / "q" / "a.txt").write_text("SELECT ?a")
    got = {r.query_id: r.query for r in text.read_query_dir(spark, str(tmp_path / "q")).collect()}
    assert got == {"a.txt": "SELECT ?a", "b.txt": "SELECT\n?b"}
    log = text.read_query_log(spark, str(tmp_path / "q" / "b.txt"))
    assert log.count() == 2 and log.select("query_id").distinct().count() == 2
    lines = ["SELECT ?a { ?a <p> ?b }", "# a comment", "SELECT ?a { ?a <p> ?b }", "", "select * where { ?x <q> ?y }"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    ids = lambda: sorted(r.query_id for r in text.read_query_log(spark, str(tmp_path / "log.txt")).collect())
    first = ids()
    assert len(set(first)) == 5 and all(i.startswith("log.txt#") for i in first)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        assert ids() == first  # however the file is cut
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in text.rejected_queries(spark, str(tmp_path / "log.txt")).collect()] == ["# a comment"]


def test_a_comment_may_follow_the_dot(spark):
    lines = ["<s> <p> <o> .", "<s> <p> <o> . # note", "<s> <p> <o>", "<s> <p> <o> # no dot .", "s p o .", "s p o", 's p "x" . # y .']
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = sorted(r.value for r in text.convert_prefixes(frame, {}).collect())
    assert got == ['s p "x" .', "s p o .", "s p o .", "s p o ."]


def test_long_numbers_compare_exactly(frame):
    big = 12345678901234567890
    rows = frame([(f'"{big}"', f'"{big + 1}"'), (f'"{big}"', f'"{big}.0"'), ('"1e3"', '"1000"'), ('"9"', '"10"'), ('"x"', '"10"')], "a string, b string")
    less = [r[0] for r in rows.select(f.compare("?a", "<", "?b")).collect()]
    same = [r[0] for r in rows.select(f.compare("?a", "=", "?b")).collect()]
    assert less == [True, False, False, True, False] and same == [False, True, True, False, False]
    assert [r[0] for r in rows.select(f.compare("?b", ">", big)).collect()] == [True, False, False, False, False]


def test_prefix_table_from_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("ub\thttp://x/ub.owl#\nrdf\thttp://x/rdf#")
    assert prefixes.load(spark, str(tmp_path / "p.txt")) == {"ub": "http://x/ub.owl#", "rdf": "http://x/rdf#"}


def test_few_namespaces_are_compared_as_the_pattern_finds_them(spark, monkeypatch):
    table = {"a": "http://x/", "b": "http://x/y/", "c": "http://x/y", "d": "urn:"}
    rows = ["<http://x/y/z>", "<http://x/yz>", "<http://x/q>", "http://x/y/z", "<urn:1", "<<urn:1>", "urn:", "<http://X/y>", "", "<", "<>", None, '"http://x/y"', "?v"]
    df = column(spark, rows)

    def compacted(names):
        return df.select(terms.compact_column(F.col("t"), names).alias("x"))

    for names in (table, table | {"all": ""}, {"one": "http://x/"}):
        few = compacted(names)
        monkeypatch.setattr(terms, "COMPARED", 0)
        assert values(few) == values(compacted(names))
        monkeypatch.undo()
        plan = few._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract" not in plan and "lambda" not in plan
