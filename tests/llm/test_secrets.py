"""Secret scans against regular expressions and entropies counted anew for every window."""

import hashlib
import math
import random
import re
import string
from collections import Counter

import duckdb
import pytest

from tripleweave.llm import secrets


def plain_windows(candidate):
    for s in range(len(candidate) - secrets.WINDOW + 1):
        w = candidate[s : s + secrets.WINDOW]
        digits = sum(c in string.digits for c in w)
        letters = sum(c in string.ascii_letters for c in w)
        if digits < 3 or letters < 3:
            continue
        if set(w) <= set("0123456789abcdef"):
            kind = "hex"
        elif set(w) <= set(string.digits + string.ascii_lowercase):
            kind = "lower"
        elif set(w) <= set(string.digits + string.ascii_uppercase):
            kind = "upper"
        else:
            kind = "mixed"
        bits = math.log2(len(w)) - sum(n * math.log2(n) for n in Counter(w).values()) / len(w)
        if bits >= secrets.THRESHOLDS[kind] - 1e-9:
            yield s


def plain(doc, text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base, added = sorted(spans), []
    for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
        if any(re.search(a, m[0]) for a in secrets.ALLOWED):
            continue
        covered = sorted({m.start() + s + i for s in plain_windows(m[0]) for i in range(secrets.WINDOW)})
        for i, x in enumerate(covered):
            if i == 0 or x != covered[i - 1] + 1:
                added.append([x, 3, x + 1])
            added[-1][2] = x + 1
    added = [tuple(a) for a in added if not any(b <= a[0] and a[2] <= e for b, _, e in base)]
    names = [*secrets.KINDS, secrets.ENTROPY]
    show = lambda rows: ",".join(f"{names[k]}:{b}:{e}" for b, k, e in rows)
    of = lambda k: sum(s[1] == k for s in base)
    return doc, of(0), of(1), of(2), hashlib.sha256(show(base).encode()).hexdigest(), show(sorted(base + added))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    some = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    every = string.ascii_letters + string.digits + "+/_-"
    out = []
    for doc in range(120):
        parts = [rng.choice(["é", "words here", "the_long_name_of_a_function", "漢字"]) for _ in range(3)]
        parts += [some(every, rng.randint(18, 60)), some("0123456789abcdef", rng.randint(18, 50)), some(string.ascii_uppercase + string.digits, 24)]
        parts += [rng.choice(["Password", "api_key", "APIKEY", "token", "secret"]) + rng.choice(['="', ": ", " = '"]) + some(every, rng.randint(4, 30))]
        parts += ["AKIA" + some(string.ascii_uppercase + string.digits, rng.randint(5, 20)), some("ab1", 30), some("abc123", 40)]
        parts += ["EXAMPLE" + some(every, 30), "123e4567-e89b-12d3-a456-426614174000", "path/to-some/other_file/12"]
        rng.shuffle(parts)
        out.append((doc, rng.choice([" ", "\n", ", "]).join(parts)))
    long = some(every, 3000) + "a" * 700 + some(every, 700)
    out += [
        (200, f"x {long} y {some('0123456789abcdef', 1200)}"),
        (201, "token: secret: abcdefgh1 password==abcdefgh token:token:token:token"),
        (202, " ".join(f"password=abcdefgh{i}" for i in range(1500))),
        (203, None), (204, ""), (204, ""), (None, "api_key=\"0123456789\" ſecret=abcdefghij toKen=abcdefghij"),
    ]
    return out


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_digest_as_plain_programs_and_sql(spark, texts):
    frame = spark.createDataFrame([(*t, "s", 1) for t in texts], "doc_id long, text string, findings string, _spans int")
    got = rows_of(secrets.digest(frame))
    expected = sorted((plain(*t) for t in texts), key=repr)
    assert got == expected
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    assert sorted(con.execute(secrets.SQL).fetchall(), key=repr) == expected
    assert sum("entropy" in r[-1] for r in got) > 100


def test_findings_keep_columns_and_the_allow_list_suppresses(spark):
    token = "q7Zp3Lw9Xc2Vb8Nm4Kd6"
    frame = spark.createDataFrame([(1, f"see {token} here", 5)], "doc_id long, text string, _spans int")
    row = secrets.findings(frame).first()
    assert row["_spans"] == 5 and [tuple(f) for f in row.findings] == [("entropy", 4, 24)]
    assert secrets.findings(frame, (*secrets.ALLOWED, "^q7Zp")).first().findings == []
    assert secrets.digest(frame.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = "plain words " * 1_000_000 + "password=abcdefgh12"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert secrets.digest(frame).first().spans == f"assign:{len(text) - 19}:{len(text)}"


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = secrets.digest(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
