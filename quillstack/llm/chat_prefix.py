"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only that reply
is trainable. Turns after the last assistant turn (or a conversation without one) give one more example
without a target, so that the examples hold every turn.

Template: ``<|im_start|>{role}\\n{text}<|im_end|>\\n`` for each turn. Control strings inside texts and
roles are broken by an escape character, which is itself escaped; ``unescape`` restores them.

Defined cases: null texts and roles are empty; a null conversation id is a conversation; equal turn
numbers are ordered by role and text; repeated rows are turns of their own; extra columns are ignored; an empty
table gives an empty result; a very long text is whole, within what a row can hold.
The last example of a conversation holds the whole of it, so a conversation must fit a row, as its
formatted text must in any case. Prefixes are made one at a time while rows are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"

# Strings that common chat templates reserve.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")

ESCAPE = "␛"
_REGEX = "(?s)(?=" + "|".join(f"\\Q{c}\\E" for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    """Writes E as E0 and puts E1 after the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(_REGEX), F.lit(f"$1{ESCAPE}1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    """As ``escape``; a newline, which ends the role, becomes E2."""
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "2"), F.lit("\n")))


def format_examples(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text): conv_id, target (0-based turn, null without one),
    n_turns (in the example), is_last, formatted, loss_start and loss_end (code points of ``formatted``)."""
    one = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    talks = talks.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t.role), F.lit("\n"), escape(t.text), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.length(escape(t.text))).alias("sizes"),
        F.filter(
            F.transform("turns", lambda t, i: F.when(t.role == target_role, i)), lambda i: i.isNotNull()
        ).alias("targets"),
    )
    last = F.size("parts") - 1
    ends_in_target = F.coalesce(F.try_element_at("targets", F.lit(-1)) == last, F.lit(False))
    stops = F.transform("targets", lambda i: F.struct(i.alias("target"), i.alias("stop")))
    tail = F.array(F.struct(F.lit(None).cast("int").alias("target"), last.alias("stop")))
    rows = talks.withColumn("at", F.explode(F.when(ends_in_target, stops).otherwise(F.concat(stops, tail))))
    rows = rows.select(
        "conv_id",
        F.col("at.target").alias("target"),
        (F.col("at.stop") + 1).alias("n_turns"),
        (F.col("at.stop") == last).alias("is_last"),
        F.array_join(F.slice("parts", F.lit(1), F.col("at.stop") + 1), "").alias("formatted"),
        F.get("sizes", F.col("at.target")).alias("size"),
    )
    end = F.length("formatted") - len(END)
    return rows.select(
        "conv_id", "target", "n_turns", "is_last", "formatted",
        F.when(F.col("target").isNotNull(), end - F.col("size")).alias("loss_start"),
        F.when(F.col("target").isNotNull(), end).alias("loss_end"),
    )


def parse_turns(formatted: Column) -> Column:
    """Reads the turns back: array of (role, text)."""
    bodies = F.split(formatted, "\\Q" + END + "\\E", -1)
    bodies = F.slice(bodies, F.lit(1), F.size(bodies) - 1)
    return F.transform(
        bodies,
        lambda b: F.struct(
            unescape_role(F.substring_index(F.substr(b, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(b, F.locate("\n", b) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped; null without a target."""
    return unescape(F.substr(formatted, start + 1, end - start))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted texts alone: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, n_examples."""
    turns = parse_turns(F.col("formatted"))
    digest = F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256)
    parsed = examples.select(
        "conv_id",
        F.when(F.col("is_last"), F.size(turns)).alias("n_turns"),
        F.length("formatted").alias("chars"),
        F.when(F.col("is_last"), digest).alias("digest"),
        F.struct("target", loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")).alias("loss"),
    )
    whole = parsed.groupBy("conv_id").agg(
        F.max("n_turns").cast("long").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: F.coalesce(x.text, F.lit(""))), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    return whole.select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "n_examples",
    )
