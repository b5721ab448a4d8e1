"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context
and only its text is trainable. Turns after the last reply form a last example with
nothing trainable, so that a formatted conversation can be read back whole.

Template: each turn is `<s>role\\ntext</s>`. Inside roles and texts a backslash becomes two,
and each control string gets a backslash after its first character; a line feed in a role
gets one before it. So every backslash starts a pair, `\\x` stands for x, and no control
string occurs inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Control strings of common templates; none may appear unescaped inside a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL_PATTERN = r"(<|\[)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL_PATTERN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`(conv_id, turns)`: the formatted turns of each conversation in order.

    Rows are ordered by turn, then role and text (ties and repeated rows keep all rows;
    null turns come first). Null roles and texts count as empty; a null id is a
    conversation of its own. A conversation is one row, as its last example is anyway.
    """
    head = F.concat(F.lit(OPEN), _role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    row = F.struct(
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        head.alias("head"),
        escape(F.coalesce(F.col(text), F.lit(""))).alias("body"),
    )
    return conversations.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def examples(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    reply_role: str = "assistant",
) -> DataFrame:
    """`(conv_id, example, last, prompt, target)`.

    `prompt` has all turns before the reply and the head of the reply; `target` is the
    reply's text and its end mark, of which all but the mark (`loss_end`) is trainable.
    The example of the trailing turns has an empty target. An empty table gives no rows.
    """
    turns = turns_of(conversations, conv_id, turn, role, text)
    n = F.size("turns")
    replies = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == reply_role)
    trailing = F.element_at("turns", -1)["role"] != reply_role
    cuts = F.when(trailing, F.concat(replies, F.array(n + 1))).otherwise(replies)
    made = turns.select("conv_id", "turns", F.posexplode(cuts).alias("example", "at"))
    whole = F.transform(F.slice("turns", 1, F.col("at") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE)))
    reply = F.get(F.col("turns"), F.col("at") - 1)
    return made.select(
        "conv_id",
        F.col("example").cast("bigint").alias("example"),
        (F.col("at") >= n).alias("last"),
        F.concat(F.array_join(whole, ""), F.coalesce(reply["head"], F.lit(""))).alias("prompt"),
        F.coalesce(F.concat(reply["body"], F.lit(CLOSE)), F.lit("")).alias("target"),
        F.coalesce(F.char_length(reply["body"]), F.lit(0)).cast("bigint").alias("loss_end"),
    )


def loss_text(target: Column, loss_end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(target, F.lit(1), loss_end.cast("int")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.slice(F.split(formatted, CLOSE), F.lit(1), F.size(F.split(formatted, CLOSE)) - 1)
    pattern = r"(?s)^<s>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, pattern, 1)).alias("role"), unescape(F.regexp_extract(p, pattern, 2)).alias("text")
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """`(conv_id, n_turns, turns_text, loss_text, formatted_chars)` from the examples alone.

    The last example of a conversation holds all its turns; the replies come one from each
    example, in order.
    """
    target = F.struct("example", loss_text(F.col("target"), F.col("loss_end")).alias("loss"))
    whole = F.max(F.when(F.col("last"), F.concat("prompt", "target")))
    per = formatted.groupBy("conv_id").agg(
        whole.alias("whole"),
        F.sort_array(F.collect_list(target)).alias("losses"),
        F.sum(F.char_length("prompt") + F.char_length("target")).cast("bigint").alias("formatted_chars"),
    )
    turns = read_turns(F.col("whole"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return per.select(
        "conv_id",
        F.size(turns).cast("bigint").alias("n_turns"),
        F.array_join(lines, "").alias("turns_text"),
        F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"),
        "formatted_chars",
    )
