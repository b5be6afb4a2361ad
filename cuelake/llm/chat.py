"""Chat formatting from an event log.

A log row tells what happened to a message: a whole text, a streamed piece, an edit that
replaces the text so far, or a regeneration that starts the message anew and drops the
messages begun between. The log is dealt out by conversation and sorted by sequence; events
fold into final messages, messages into one formatted text with a loss mask.

Template: ``### <Role>: <text></turn>`` and a line end per turn. Inside texts and role names
``\\`` becomes ``\\\\``, ``###`` becomes ``\\h`` and ``</turn>`` becomes ``\\e``, so no control
string is left and the reverse is unique. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\e"))


def unescape(c: Column) -> Column:
    """The reverse of :func:`escape`: escaped backslashes are set apart first, so pairs are read from the left."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")))
    return F.array_join(plain, "\\")


def _role_out(role: Column) -> Column:
    """Known roles are spelt with a capital; others keep their spelling behind ``=``, colons escaped."""
    known = role.isin("user", "assistant", "system", "tool")
    return F.when(known, F.initcap(role)).otherwise(F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\c"))))


def _role_in(label: Column) -> Column:
    own = F.substr(label, F.lit(2))
    parts = F.transform(F.split(own, r"\\\\", -1), lambda p: F.replace(F.replace(F.replace(
        p, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\c"), F.lit(":")))
    return F.when(label.startswith("="), F.array_join(parts, "\\")).otherwise(F.lower(label))


def fold_events(log: DataFrame) -> DataFrame:
    """conv_id, msg (its first sequence number and name), role, text of the messages that remain.

    ``log``: conv_id, seq, msg, kind, role, text. ``message`` and ``edit`` set the text, ``delta``
    adds to it, ``regenerate`` empties it, sets the text given and drops messages begun since the
    message was. Events of one seq go by kind, role and text; a repeated event counts as often
    as it occurs. Null text is empty, null role an empty role, unknown and null kinds are deltas. A
    message is ordered by its first event. Extra columns are not read.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"), F.lit(0))
    kind = F.when(kind == 0, F.lit(2)).otherwise(kind)
    e = log.select("conv_id", "msg", F.struct(F.col("seq"), kind.alias("k"), role.alias("role"), text.alias("text")).alias("e"))
    # Dealt by conversation once: what follows groups by it or by more.
    per_msg = e.repartition("conv_id").groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list("e")).alias("e"))
    resets = F.transform("e", lambda x, i: F.when(x["k"] != 2, i + 1))
    last = F.coalesce(F.array_max(resets), F.lit(1))
    live = F.slice("e", last, F.size("e"))
    m = per_msg.select("conv_id", "msg", F.col("e")[0]["seq"].alias("first"), F.element_at("e", -1)["role"].alias("role"),
                       F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
                       F.array_max(F.transform(F.filter("e", lambda x: x["k"] == 4), lambda x: x["seq"])).alias("again"))
    before = Window.partitionBy("conv_id").orderBy("first", "msg", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    dropped = F.coalesce(F.max("again").over(before) > F.col("first"), F.lit(False))
    return m.withColumn("dropped", dropped).filter(~F.col("dropped")).select("conv_id", "first", "msg", "role", "text")


def format_messages(messages: DataFrame, train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss (spans of code points [start, end) of the texts to learn, as they lie in formatted).

    A conversation is one row, as it is one training text. One without messages has no row.
    """
    head = F.concat(F.lit(HEAD), _role_out(F.col("role")), F.lit(MID))
    rows = messages.select("conv_id", F.struct("first", "msg", head.alias("head"), escape(F.col("text")).alias("body"),
                                               F.col("role").isin(*train_roles).alias("learn")).alias("m"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        a = s["at"] + F.char_length(x["head"])
        b = a + F.char_length(x["body"])
        span = F.array(F.struct(a.cast("long").alias("start"), b.cast("long").alias("end")))
        return F.struct((b + len(TAIL)).cast("long").alias("at"), F.when(x["learn"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return g.select("conv_id",
                    F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))), "").alias("formatted"),
                    F.aggregate("m", start, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text), learned (text of all loss spans, unescaped)."""
    turns = F.filter(F.split("formatted", "</turn>\n", -1), lambda x: x != "")
    label = lambda x: F.substr(F.substring_index(x, MID, 1), F.lit(len(HEAD) + 1))
    role = lambda x: _role_in(label(x))
    body = lambda x: unescape(F.substr(x, F.char_length(F.substring_index(x, MID, 1)) + len(MID) + 1))
    spans = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted",
                            F.transform(turns, lambda x: F.struct(role(x).alias("role"), body(x).alias("text"))).alias("turns"),
                            F.array_join(spans, "").alias("learned"))


def table_log(rows: DataFrame) -> DataFrame:
    """Rows by turn as an event log: user and system rows as whole messages, others streamed in pieces.

    As in a real log, not all goes well at once: every third message is a draft that an edit replaces, every third streamed
    one breaks off, is answered, and is regenerated, which takes the broken text and the answer back. Equal turns of a
    conversation are ordered by role and text; each row is a message.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    w = Window.partitionBy("conv_id", "turn").orderBy(role, text)
    named = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.row_number().over(w).alias("n"))
    whole = F.col("role").isin("user", "system")
    troubled = F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(3)) == 0

    def event(i, kind: str, said: Column, who: Column | None = None, other: int = 0) -> Column:
        return F.struct(F.lit(i).alias("i") if isinstance(i, int) else i.alias("i"), F.lit(other).alias("other"), F.lit(kind).alias("kind"),
                        (F.col("role") if who is None else who).alias("role"), said.alias("text"))

    pieces = F.when(F.col("text") == "", F.array("text")).otherwise(F.regexp_extract_all("text", F.lit("(?s).{1,400}"), F.lit(0)))
    streamed = F.transform(pieces, lambda p, i: event(i, "delta", p))
    broken = F.array(event(-3, "delta", F.lit("This breaks </turn>")), event(-2, "message", F.lit("And then?"), F.lit("user"), 1), event(-1, "regenerate", F.lit("")))
    events = (F.when(whole & troubled, F.array(event(-1, "message", F.lit("a draft ###")), event(0, "edit", F.col("text"))))
              .when(whole, F.array(event(0, "message", F.col("text"))))
              .when(troubled, F.concat(broken, streamed)).otherwise(streamed))
    e = named.select("conv_id", "turn", "n", F.inline(events))
    return e.select("conv_id", F.struct("turn", "n", "i").alias("seq"), F.struct("turn", "n", "other").alias("msg"), "kind", "role", "text")
