import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from quillstack.llm import secret_links as s
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of


def brute(text):
    """(base, spans) by Python's own scanner and all pairs."""
    text = text or ""
    find = lambda k, p, ok=lambda m: True: [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m)]
    letters = lambda m, *c: all(re.search(x, m[0]) for x in c)
    base = find(0, s.ASSIGN, lambda m: len(m[2]) >= 8) + find(1, "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16) + find(2, "[0-9a-f]+", lambda m: len(m[0]) >= 32)
    weak = find(3, s.NAMED_ID) + find(3, "[A-Z0-9]+", lambda m: 16 <= len(m[0]) <= 24 and letters(m, "[A-Z]", "[0-9]"))
    weak += find(4, "[A-Za-z0-9+/]+", lambda m: len(m[0]) == 40 and letters(m, "[A-Z]", "[a-z]", "[0-9]")) + find(5, s.ENDPOINT)
    linked = set()
    for w in weak:
        near = [p for p in base + weak if p[0] <= w[2] + s.SCOPE and w[0] <= p[2] + s.SCOPE]
        ident, secret = any(p[1] in (1, 3) for p in near), any(p[1] in (0, 2, 4) for p in near)
        covered = any(p[1] < 3 and p[0] < w[2] and w[0] < p[2] for p in base)
        if not covered and {3: secret, 4: ident, 5: ident and secret}[w[1]]:
            linked.add(w)
    return sorted(base), sorted([*base, *linked])


def listed(spans):
    return ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def check(df):
    for r in df.collect():
        base, spans = brute(r.text)
        assert [tuple(x) for x in r.base] == base, r.text
        assert [tuple(x) for x in r.spans] == spans, r.text


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES["op8_secret_links"](spark, SF)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op8_secret_links']})").fetchall(), key=repr) == rows_of(df)


def test_documents(spark):
    check(s.scan(spark.read.parquet(f"{SF}/documents.parquet"), keep=["doc_id", "text"]))


def test_assembled_texts(spark):
    r = random.Random(8)
    key = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"[:39] + "9"
    bits = [key, key + "x", "ASIAQ7" + "X1" * 6, "AKIA" + "A1B2" * 4, "AKIAshort", "token: secret: abcdefgh12", "Password = 'short'", 'API_KEY="abcd1234efgh"', "0f" * 20, "f" * 31, "user_name: bob", "https://db.example.com:5432/x", "é", "😀", " ", "\n", "filler words here ", "x" * 290, "=", "secret=token=abcdefgh"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", "\n"]) for _ in range(r.randint(1, 14))) for _ in range(250)]
    texts += ["token=abcdefgh " * 300, "".join(f"0{i:x}" * 20 + "g" for i in range(200))]
    check(s.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")))


def test_weak_parts_alone_are_silent(spark):
    key, ident, url = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12", "ASIAQ7X1X1X1X1X1X1", "https://s3.example.com/b"
    rows = [(0, key), (1, ident), (2, url), (3, f"{ident} {key}"), (4, f"{ident} {key} {url}"), (5, f"{ident} {url}"), (6, ident + " " * 301 + key), (7, ident + " " * 300 + key)]
    got = {r.doc_id: r.spans for r in s.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in (0, 1, 2, 5, 6)] == [""] * 5
    assert got[3] == "id:0:18,key:19:59" and got[4] == got[3] + ",endpoint:60:84" and got[7] == "id:0:18,key:318:358"


def test_redaction_and_odd_rows(spark, odd_docs):
    got = {r.doc_id: r.text for r in s.redact(odd_docs).where("doc_id IN (3, 10)").collect()}
    assert got == {3: None, 10: "[SECRET] [SECRET] [SECRET] 😀 [SECRET]"}
    assert s.redact(odd_docs).columns == odd_docs.columns
    assert s.redact(odd_docs.where("doc_id <> 10")).exceptAll(odd_docs.where("doc_id <> 10")).count() == 0
    rep = s.report(odd_docs.withColumn("spans", F.lit("x")))
    assert rep.count() == odd_docs.count()
    assert {r.base_sha256 for r in rep.where("doc_id = 3").collect()} == {hashlib.sha256(b"").hexdigest()}
    assert s.report(odd_docs.limit(0)).count() == 0
