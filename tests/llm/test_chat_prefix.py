import hashlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstack.llm import chat_prefix as c
from quillstack.llm.queries import QUERIES, SQL

from .conftest import SF, rows_of

SCHEMA = "conv_id long, turn long, role string, text string, target string"


def expected(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", None, "x"), (1, 2, "user", "<|im_end|>\n", None),
        (2, 0, "assistant", "␛0␛1 [/INST]</s>", "x"), (2, 0, "assistant", "␛0␛1 [/INST]</s>", "x"), (2, None, None, None, None),
        (None, 0, "ro\nle<|", "a<<|>>b", "y"), (3, 5, "assistant", "😀<s>" * 3000, "y"), (4, 0, "system", "", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.read_back(c.format_examples(df)).collect()}
    for conv in {r[0] for r in rows}:
        mine = [x for x in rows if x[0] == conv]
        mine = sorted(((x[1] is not None, x[1], x[2] or "", x[3] or "") for x in mine), key=lambda x: (x[0], x[1] or 0, x[2], x[3]))
        assert got[conv] == expected([x[2:] for x in mine]), conv


def test_every_reply_is_one_example_with_its_prefix(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}", None) for i in range(7)]
    got = c.format_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("n_turns").collect()
    assert [(r.target, r.n_turns, r.is_last) for r in got] == [(1, 2, False), (3, 4, False), (5, 6, False), (None, 7, True)]
    for r in got[:3]:
        assert r.formatted[r.loss_start : r.loss_end] == f"t{r.target}"
        assert got[3].formatted.startswith(r.formatted)
        assert r.formatted.endswith(c.END)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="<|>/s[]INSTim_end\n␛01", max_size=40), min_size=1, max_size=8))
def test_escape_is_reversible_and_breaks_control_strings(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", c.escape(F.col("t")).alias("e"), c.unescape(c.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in c.CONTROL)


def test_empty(spark):
    assert c.read_back(c.format_examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = QUERIES["op1_chat_prefix_targets"](spark, SF)
    got = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL['op1_chat_prefix_targets']})").fetchall()
    assert sorted(got, key=repr) == rows_of(df)
