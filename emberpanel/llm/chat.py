"""Chat formatting whose output parses back to its source.

A turn is an opener, a space, its text, a space and a closer; a conversation is its turns, one a line. The parser is a regular
expression without choices: opener, the shortest text, closer. A turn whose rendering does not parse back to itself is
escaped: each control string in it, with the backslashes before it, gets one more backslash. The whole conversation is then
parsed and compared with its source; if it differs, all its turns are escaped, and if it differs still, that is an error. The loss
mask is cut from the formatted text itself. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberpanel.llm.common import let

#: Opener and closer by role; other roles carry their name before the text.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("<<ROLE>>", "<</ROLE>>")
CONTROL = r"(?:</?s>|\[/?INST\]|<</?(?:SYS|ROLE)>>)"
_OPEN = r"(<s>|\[INST\]|<<SYS>>|<<ROLE>>)"
_CLOSE = r"(?:</s>|\[/INST\]|<</SYS>>|<</ROLE>>)"
_TURN = rf"(?s){_OPEN} (.*?) {_CLOSE}(?:\n|\z)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"(\\*{CONTROL})"), F.lit(r"\\$1"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"\\(\\*{CONTROL})"), F.lit("$1"))


def render_turn(role: Column, text: Column) -> Column:
    """``role`` and ``text`` as they are; a role's line ends and percent signs are percent-coded."""
    name = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    out = F.concat(F.lit(f"{OTHER[0]} "), name, F.lit("\n"), text, F.lit(f" {OTHER[1]}"))
    for known, (begin, end) in MARKS.items():
        out = F.when(role == known, F.concat(F.lit(f"{begin} "), text, F.lit(f" {end}"))).otherwise(out)
    return out


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    openers, bodies = (F.regexp_extract_all(rendered, F.lit(_TURN), F.lit(k)) for k in (1, 2))

    def turn(opener: Column, body: Column) -> Column:
        named = opener == OTHER[0]
        name = F.replace(F.replace(F.substring_index(body, "\n", 1), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        role = F.lit(None).cast("string")
        for known, (begin, _) in MARKS.items():
            role = F.when(opener == begin, F.lit(known)).otherwise(role)
        text = F.when(named, F.substring(body, F.length(F.substring_index(body, "\n", 1)) + 2, F.length(body))).otherwise(body)
        return F.struct(F.when(named, unescape(name)).otherwise(role).alias("role"), unescape(text).alias("text"))

    return F.zip_with(openers, bodies, turn)


def format_chats(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_col``, n_turns, formatted, loss_spans, recovered, loss_text, identical.

    ``loss_spans``, the loss mask, are [start, end) code points of the loss role's texts in ``formatted``; ``recovered`` is what the
    parser reads back; ``loss_text`` is what lies under the mask, cut from ``formatted`` and unescaped, one span after another;
    ``identical`` is true: a conversation whose turns are not read back as they were is an error when that column is asked for.

    Turns stand by turn number; equal numbers by role, then text, so repeated rows stay as turns of their own. Null turn numbers
    come first; null roles and texts are empty; null conversation ids are one conversation. Whole texts are formatted, however long.
    An empty table gives no rows. A conversation's text is one value of the result, so its turns meet in one task. Other columns are
    ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), role.alias("_role"), text.alias("_text"))
    known = F.col("_role").isin(*MARKS)
    raw = render_turn(F.col("_role"), F.col("_text"))
    clash = F.col("_text").rlike(CONTROL) | F.col("_role").rlike(CONTROL)
    same = parse(raw) == F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    safe = render_turn(F.when(known, F.col("_role")).otherwise(escape(F.col("_role"))), escape(F.col("_text")))
    turns = turns.withColumn("_piece", F.when(~clash & same, raw).otherwise(safe))
    turns = turns.withColumn("_safe", safe)
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text")
    opener, closer = F.lit(len(OTHER[0])), F.lit(len(OTHER[1]))
    for name, (a, b) in MARKS.items():
        opener = F.when(F.col("_role") == name, F.lit(len(a))).otherwise(opener)
        closer = F.when(F.col("_role") == name, F.lit(len(b))).otherwise(closer)

    def span(piece: str) -> Column:
        """[start, end) of the turn's text when the conversation's turns are rendered as ``piece``."""
        width = F.length(piece)
        end = F.sum((width + 1).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
        head = F.when(known, 0).otherwise(F.length(F.substring_index(piece, "\n", 1)) - opener)
        return F.struct((end - width + opener + 1 + head).alias("start"), (end - closer - 1).alias("end"))

    turns = turns.withColumns({"_at": F.row_number().over(order), "_span": span("_piece"), "_safe_span": span("_safe")}).drop("_safe")
    packed = F.sort_array(F.collect_list(F.struct("_at", "_role", "_text", "_piece", "_span", "_safe_span")))
    chats = turns.groupBy("_conv").agg(packed.alias("_turns"))
    chats = chats.withColumn("_once", F.array_join(F.transform("_turns", lambda t: t["_piece"]), "\n"))
    chats = chats.withColumn("_first", parse(F.col("_once")))
    source = F.transform("_turns", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text")))
    chats = chats.withColumn("_good", F.col("_first") == source)
    # Until identical: first only the turns that need it are escaped, then every turn.
    every = F.transform("_turns", lambda t: render_turn(F.when(t["_role"].isin(*MARKS), t["_role"]).otherwise(escape(t["_role"])), escape(t["_text"])))
    chats = chats.withColumn("formatted", F.when(F.col("_good"), F.col("_once")).otherwise(F.array_join(every, "\n")))
    chats = chats.withColumn("recovered", F.when(F.col("_good"), F.col("_first")).otherwise(parse(F.col("formatted"))))
    failed = F.raise_error(F.concat(F.lit("a conversation does not parse back to its turns: "), F.coalesce(F.col("_conv").cast("string"), F.lit("null"))))
    spans = F.transform(F.filter("_turns", lambda t: t["_role"] == loss_role), lambda t: F.when(F.col("_good"), t["_span"]).otherwise(t["_safe_span"]))
    chats = chats.withColumns({"identical": F.when(F.col("_good") | (F.col("recovered") == source), F.lit(True)).otherwise(failed.cast("boolean")), "loss_spans": spans})
    # Four bytes a character, so each span is cut at once however long the conversation is.
    cut = lambda wide: F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["end"] - s["start"]) * 4).cast("int")), "UTF-32")))
    loss = let(F.encode("formatted", "UTF-32"), lambda wide: F.array_join(cut(wide), ""))
    return chats.select(F.col("_conv").alias(conv_col), F.size("recovered").cast("long").alias("n_turns"), "formatted", "loss_spans", "recovered", loss.alias("loss_text"), "identical")
