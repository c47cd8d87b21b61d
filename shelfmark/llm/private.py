"""Personal data by patterns and bootstrapped contexts, in DataFrame functions only.

The base finds e-mail and IP addresses, card numbers and phone numbers by their form. These are the
seeds of the second step: the words beside them are lexical patterns, a pattern is as sure of a kind
as the share of the different values in its place that are known to be of that kind, and tokens that
look like identifiers (with digits or an @) and stand in a sure place become known themselves. A few
rounds over the graph of patterns and values add spans that no form describes. Only values and
context words are shuffled, never texts; a frequent pattern is a partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import settle

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The forms, written so that a match is looked for once per run of characters and never gives back what it took.
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPACE = r"\x20\x09-\x0D"
#: A token with a digit or an @.
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+"
_GROUP = rf"[^{_SPACE}A-Za-z0-9]*+[0-9][^{_SPACE}A-Za-z]*+(?![^{_SPACE}])"
#: Neighbouring tokens of digits without letters.
RUN = rf"(?<![^{_SPACE}]){_GROUP}(?:[\x20\x09]++{_GROUP})++"
REACH = 48  # characters of context on either side


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    n = F.length(_digits(text))
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), F.call_function("luhn_check", _digits(text))).otherwise(False)
    return (n >= 9) & (n <= 15)


def spans_of(text: Column, form: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pairs = F.zip_with(F.split(text, form, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("value")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["value"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))))).alias("spans"))

    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """Base matches of all kinds, by kind and start: array<struct<kind, start, end, value>>."""
    signs = {"email": text.contains("@"), "ip": text.rlike("[0-9][.][0-9]"), "card": text.rlike(FORMS["card"]), "phone": text.contains("+")}
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")

    def of(kind: str) -> Column:
        good = F.filter(spans_of(text, FORMS[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*[F.when(signs[kind], of(kind)).otherwise(none) for kind in KINDS])


def _context(text: Column, start: Column, end: Column) -> list[Column]:
    """The word before and the word after a span, lower-cased; empty at the ends of the text."""
    low = F.greatest(start - REACH, F.lit(0))
    before = F.regexp_extract(F.substring(text, low + 1, start - low), rf"([^{_SPACE}]+)[{_SPACE}]*$", 1)
    after = F.regexp_extract(F.substring(text, end + 1, F.lit(REACH)), rf"^[{_SPACE}]*([^{_SPACE}]+)", 1)
    return [F.lower(before).alias("left"), F.lower(after).alias("right")]


def mentions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One slim row per row of ``docs``: id, key (text hash), base spans, other candidates and tokens inside these, all with their contexts.

    Candidates are runs of digit groups between the base spans, and tokens outside these runs.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    likely = text.rlike("[0-9@]")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    rows = rows.withColumn("base", F.when(likely, base_spans(text)).otherwise(none))
    tokens = F.filter(spans_of(text, TOKEN), lambda s: (F.length(_digits(s["value"])) >= 4) | s["value"].contains("@"))
    other = F.transform(tokens, lambda s: F.struct(F.lit("").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    rows = rows.withColumn("other", F.when(likely, other).otherwise(none))
    rows = rows.withColumn("other", F.filter("other", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    length = lambda s: s["end"] - s["start"]
    masked = F.aggregate("base", text, lambda acc, s: F.overlay(acc, F.repeat(F.lit("x"), length(s)), s["start"] + 1, length(s)))
    runs = F.filter(spans_of(masked, RUN), lambda s: F.length(_digits(s["value"])) >= 4)
    runs = F.transform(runs, lambda s: F.struct(F.lit("").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    rows = rows.withColumn("runs", F.when(text.rlike(rf"[0-9][^{_SPACE}]*+[\x20\x09]++[^{_SPACE}0-9]*+[0-9]"), runs).otherwise(none))
    inside = lambda s: F.exists("runs", lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"]))
    rows = rows.withColumns({"inner": F.filter("other", inside), "other": F.concat("runs", F.filter("other", lambda s: ~inside(s)))})

    def shown(column: str) -> Column:
        return F.transform(column, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), *_context(text, s["start"], s["end"]))).alias(column)

    return rows.select("id", "key", shown("base"), shown("other"), shown("inner"))


def discover(found: DataFrame, least: float = 0.9, support: int = 5, rounds: int = 3) -> DataFrame:
    """(value, kind): candidate values that sure patterns place.

    A pattern needs ``support`` different known values of a kind, and a share of at least ``least`` of
    all different values in its place. At the start or end of a text the other side's word is the
    pattern. A value takes the kind it is surest of, the earlier in KINDS on a tie.
    """
    seen = found.select(F.explode(F.concat("base", "other")).alias("s")).select("s.kind", "s.value", "s.left", "s.right")
    has = {side: F.col(side) != "" for side in ("left", "right")}
    patterns = F.array_compact(F.array(
        F.when(has["left"], F.concat(F.lit("l "), "left")), F.when(has["right"], F.concat(F.lit("r "), "right")), F.when(has["left"] & has["right"], F.concat_ws(" ", F.lit("b"), "left", "right"))
    ))
    edges = seen.select("kind", "value", F.explode(patterns).alias("pattern")).distinct()
    edges = settle(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    known = edges.where("kind <> ''").select("value", "kind").distinct()
    free = edges.where("kind = ''").select("pattern", "value")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    for _ in range(rounds):
        per = edges.select("pattern", "value").join(known, "value").groupBy("pattern", "kind").agg(F.count("*").alias("sure")).where(F.col("sure") >= support)
        sure = per.join(size, "pattern").select("pattern", "kind", (F.col("sure") / F.col("n")).alias("score")).where(F.col("score") >= least)
        scored = free.join(sure, "pattern").groupBy("value").agg(F.max(F.struct("score", (-rank).alias("rank"), "kind")).alias("best"))
        taken = settle(scored.select("value", "best.kind"), "taken")
        known = edges.where("kind <> ''").select("value", "kind").distinct().unionByName(taken)
    return taken


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9, support: int = 5, rounds: int = 3) -> DataFrame:
    """One row per row of ``docs``: the id, base and spans, arrays of struct<kind, start, end, value>.

    base holds the matches by form, by kind (email, ip, card, phone) and start; spans holds these and
    the spans that contexts add, in the same order; of two that contexts add, one inside the other, the longer. Places are code points, ends exclusive. Null and
    empty texts have no spans. Rows that repeat id and text get the same spans. Other columns are not
    read.
    """
    found = settle(mentions(docs, id_col, text_col), "mentions")
    taken = discover(found, least, support, rounds).withColumnRenamed("kind", "as_kind")
    places = found.where(F.size("other") > 0).select("id", "key", F.explode(F.concat("other", "inner")).alias("s")).select("id", "key", "s.start", "s.end", "s.value").distinct()
    slim = "array<struct<kind:string,start:int,end:int,value:string>>"
    more = places.join(taken, "value").groupBy(F.col("id").alias("m_id"), F.col("key").alias("m_key")).agg(F.collect_list(F.struct(F.col("as_kind").alias("kind"), "start", "end", "value")).alias("more"))
    wider = lambda s: F.exists("more", lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))
    more = more.withColumn("more", F.filter("more", lambda s: ~wider(s)))
    joined = found.join(more, F.col("id").eqNullSafe(F.col("m_id")) & F.col("key").eqNullSafe(F.col("m_key")), "left")
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    every = F.concat(base, F.coalesce("more", F.array().cast(slim)))
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return joined.select(F.col("id").alias(id_col), base.alias("base"), spans.alias("spans"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
