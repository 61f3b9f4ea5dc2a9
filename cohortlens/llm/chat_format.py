"""Chat formatting with a grammar round trip.

A conversation is rendered as one string. Grammar (text holds no control string):

    conversation := turn*
    turn := '<<SYS>>' text '<</SYS>>' | '[INST]' text '[/INST]' | '<s>' text '</s>'
          | '[ROLE=name]' text '[/ROLE]'

for the roles system, user, assistant and any other. An opening with ``%`` (``[INST%]``) says
that the text is escaped: '%', '[' and '<' are written %25, %5B and %3C, which is reversible
and leaves no control string. The parser is deterministic: it cuts the string at the control
strings and accepts it when openings and closings alternate in kind with nothing between
turns. A conversation is first rendered plainly and reparsed; if the recovered turns differ
from the source, the turns that hold a control string are escaped; if they still differ, all
turns are. The last form always round-trips. ``escaped`` says which form was taken (0, 1, 2).

Only DataFrame functions are used. Turns are grouped by conversation; one conversation is one
row of the result, so it is the unit that must fit a task.

Defined results: null texts and null roles are empty strings; turns with equal numbers are
ordered by role, then text, null numbers first; repeated rows are kept; a null conversation id
is one group; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings and the pattern that finds any of them.
OPEN = {"system": ("<<SYS", ">>"), "user": ("[INST", "]"), "assistant": ("<s", ">")}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE = "[ROLE", "[/ROLE]"
CONTROL = r"<<SYS%?>>|<</SYS>>|\[INST%?\]|\[/INST\]|<s%?>|</s>|\[ROLE%?=[^\[\]<>]*\]|\[/ROLE\]"


def escape(c: Column) -> Column:
    for a, b in (("%", "%25"), ("[", "%5B"), ("<", "%3C")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in (("<", "%3C"), ("[", "%5B"), ("%", "%25")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def _role_name(c: Column) -> Column:
    """A role as it stands in ``[ROLE=...]``: without brackets of any kind."""
    c = escape(c)
    for a, b in (("]", "%5D"), (">", "%3E")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _role_back(c: Column) -> Column:
    for a, b in (("]", "%5D"), (">", "%3E")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return unescape(c)


def _render_turn(role: Column, text: Column, escaped: Column) -> Column:
    mark = F.when(escaped, F.lit("%")).otherwise(F.lit(""))
    body = F.when(escaped, escape(text)).otherwise(text)
    out = F.concat(F.lit(OTHER_OPEN), mark, F.lit("="), _role_name(role), F.lit("]"), body, F.lit(OTHER_CLOSE))
    for name, (a, b) in OPEN.items():
        out = F.when(role == name, F.concat(F.lit(a), mark, F.lit(b), body, F.lit(CLOSE[name]))).otherwise(out)
    return out


def render(turns: Column, escaped) -> Column:
    """One string from an array of (role, text); ``escaped`` maps a turn to a boolean."""
    return F.array_join(F.transform(turns, lambda t: _render_turn(t["role"], t["text"], escaped(t))), "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often lambdas inside ``use`` read it."""
    return F.transform(F.array(value), use)[0]


def _cut(formatted: Column) -> Column:
    """struct(controls, between): control strings in order and the texts around them."""
    return F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), F.lit(0)).alias("controls"),
                    F.split(formatted, CONTROL, -1).alias("between"))


def parse(formatted: Column) -> Column:
    """struct(turns, ok): recovered (role, text) turns and whether the string follows the grammar."""

    def role_of(opening: Column) -> Column:
        out = _role_back(F.regexp_replace(F.regexp_replace(opening, r"^\[ROLE%?=", ""), r"\]$", ""))
        for name, (a, b) in OPEN.items():
            out = F.when(opening.isin(a + b, a + "%" + b), F.lit(name)).otherwise(out)
        return out

    def closing_of(opening: Column) -> Column:
        out = F.when(opening.startswith(OTHER_OPEN), F.lit(OTHER_CLOSE))
        for name, (a, b) in OPEN.items():
            out = out.when(opening.isin(a + b, a + "%" + b), F.lit(CLOSE[name]))
        return out

    def read(cut: Column) -> Column:
        controls, between = cut["controls"], cut["between"]
        n = F.floor(F.size(controls) / 2).cast("int")
        places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

        def turn(i: Column) -> Column:
            opening, raw = controls[i * 2], between[i * 2 + 1]
            marked = opening.rlike(r"^(<<SYS%|\[INST%|<s%|\[ROLE%)")
            return F.struct(role_of(opening).alias("role"), F.when(marked, unescape(raw)).otherwise(raw).alias("text"))

        paired = F.forall(places, lambda i: F.coalesce(closing_of(controls[i * 2]) == controls[i * 2 + 1], F.lit(False)))
        empty = F.forall(F.sequence(F.lit(0), n), lambda i: F.coalesce(between[i * 2] == "", F.lit(False)))
        return F.struct(F.transform(places, turn).alias("turns"),
                        ((F.size(controls) % 2 == 0) & paired & empty).alias("ok"))

    return _once(_cut(formatted), read)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped, turns, loss_text, loss_spans): one row per conversation.
    ``turns`` and ``loss_text`` are read back from ``formatted``; ``loss_spans`` are the
    (start, end) code-point ranges of assistant texts in it, where training takes its loss."""
    empty = F.lit("")
    source = conversations.select(
        "conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                            F.coalesce(F.col("text").cast("string"), empty).alias("text")).alias("_t"))
    x = source.groupBy("conv_id").agg(F.collect_list("_t").alias("_t"))
    x = x.select("conv_id", F.transform(F.array_sort("_t"), lambda t: F.struct(t["role"], t["text"])).alias("_s"))
    x = x.withColumn("_f0", render(F.col("_s"), lambda t: F.lit(False))).withColumn("_p0", parse(F.col("_f0")))
    good0 = F.col("_p0.ok") & (F.col("_p0.turns") == F.col("_s"))
    # rendered again only where the plain form does not come back identical
    x = x.withColumn("_f1", F.when(~good0, render(F.col("_s"), lambda t: t["text"].rlike(CONTROL))))
    x = x.withColumn("_p1", F.when(F.col("_f1").isNotNull(), parse(F.col("_f1"))))
    good1 = F.coalesce(F.col("_p1.ok") & (F.col("_p1.turns") == F.col("_s")), F.lit(False))
    form = F.when(good0, F.lit(0)).when(good1, F.lit(1)).otherwise(F.lit(2))
    x = x.withColumn("escaped", form)
    x = x.withColumn("formatted", F.when(F.col("escaped") == 0, F.col("_f0")).when(F.col("escaped") == 1, F.col("_f1"))
                     .otherwise(render(F.col("_s"), lambda t: F.lit(True))))
    x = x.withColumn("_p", F.when(F.col("escaped") == 0, F.col("_p0")).when(F.col("escaped") == 1, F.col("_p1"))
                     .otherwise(parse(F.col("formatted"))))
    turns = F.col("_p.turns")
    loss = F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return x.select("conv_id", "formatted", "escaped", turns.alias("turns"), loss.alias("loss_text"),
                    loss_spans(F.col("formatted")).alias("loss_spans"))


def loss_spans(formatted: Column) -> Column:
    """Code-point ranges of the assistant texts: running lengths over controls and texts."""
    step = _once(_cut(formatted), lambda cut: F.zip_with(
        F.slice(cut["between"], 1, F.size(cut["controls"])), cut["controls"],
        lambda t, c: F.struct(F.length(t).alias("t"), F.length(c).alias("c"), c.alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(acc: Column, s: Column) -> Column:
        end = acc["at"] + s["t"]
        own = acc["open"].isin("<s>", "<s%>")
        more = F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))
        return F.struct((end + s["c"]).alias("at"), s["kind"].alias("open"), F.when(own, more).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(step, zero, walk, lambda acc: acc["spans"])
