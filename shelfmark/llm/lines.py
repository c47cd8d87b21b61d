"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words. Equal lines form a class, represented by their earliest place. Two classes are
near if one word inserted, deleted or replaced turns one into the other, and the longer has at least
``least_words`` words (five: four words in five stay). Every variant of a line with one word deleted
is a hashed key, and so is the line itself; near lines share a key. To emit variants only where they
can meet, a line must first share its front or back half (for its own length or one word less) with
another class, and then all but one of sixteen parts, whose words are the ones to delete: one word
leaves the rest alone, so nothing is lost.

Per key only the earliest class is looked up, so lines that share a template are not paired with
each other. The edit distance is verified on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfmark.session import settle

PARTS = 16
_BLANK = r"[\x20\x09-\x0D]+"


def words_of(line: Column) -> Column:
    """The words of a line, none for a blank one."""
    return F.filter(F.split(line, _BLANK), lambda w: w != "")


def even(line: Column) -> Column:
    """The words of a line joined by one blank. Most lines stand like that already and need not be cut."""
    return F.when(line.rlike(r"[\x09-\x0D]|^\x20|\x20(?:\x20|$)"), F.array_join(words_of(line), " ")).otherwise(line)


def _count(text: Column) -> Column:
    """How many words an evened line has."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def _front(text: Column, n: Column) -> Column:
    """The first n words of an evened line; the last ones if n is negative."""
    return F.call_function("substring_index", text, F.lit(" "), n)


def _hash(text: Column) -> Column:
    """128 bits of a run of words."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _halves(text: Column, n: Column) -> Column:
    """Keys of the front and back half, for pairs whose shorter line has n words and n - 1."""
    keys = []
    for less in (0, 1):
        half = F.floor((n - less) / 2).cast("int")
        keys += [F.xxhash64(n - less, F.lit(0), _front(text, half)), F.xxhash64(n - less, F.lit(1), _front(text, -half))]
    return F.array(*keys)


def _parts(known: DataFrame) -> DataFrame:
    """(line, less, low, high, key): a key of each of up to PARTS parts of an evened line, all the words but that part, for a
    shorter line of n words (less 0) or n - 1 (less 1)."""
    at, m = F.col("at"), F.col("n") - F.col("less")
    cut = known.select("line", "text", "n", F.explode(F.sequence(F.lit(0), F.lit(2 * PARTS - 1))).alias("at"))
    cut = cut.withColumn("less", F.floor(at / PARTS).cast("int"))
    cut = cut.withColumn("low", F.floor(m * (at % PARTS) / PARTS).cast("int")).withColumn("high", F.floor(m * (at % PARTS + 1) / PARTS).cast("int"))
    key = F.xxhash64(m, "low", "high", _front(F.col("text"), F.col("low")), F.lit("|"), _front(F.col("text"), F.col("high") - m))
    return cut.where("low < high").select("line", "less", "low", "high", key.alias("key"))


def line_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, at, line): the lines of each text that are not blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def within_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by one word inserted, deleted or replaced, at most."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    after = lambda words, skip: F.when(F.size(words) >= first + skip, F.slice(words, first + skip, F.size(words))).otherwise(F.slice(words, 1, 0))
    return (first == 0) | F.when(F.size(a) == F.size(b), after(a, 1) == after(b, 1)).when(F.size(a) == F.size(b) + 1, after(a, 1) == after(b, 0)).when(F.size(b) == F.size(a) + 1, after(a, 0) == after(b, 1)).otherwise(False)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """(id, key, at): the places of the lines that stay."""
    places = line_places(docs, id_col, text_col).withColumn("text", even(F.col("line"))).withColumn("n", _count(F.col("text")))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key", "at").alias("place")
    n = F.col("n")
    classes = places.select(_hash(F.col("text")).alias("line"), first, F.when(n >= least_words - 1, _halves(F.col("text"), n)).alias("halves"))
    classes = settle(classes.groupBy("line").agg(F.min("place").alias("place"), F.first("halves").alias("halves")), "lines")

    half = classes.where("halves is not null").select("line", F.explode(F.array_distinct("halves")).alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    asked = settle(half.join(shared, "half", "left_semi").select("line").distinct().join(classes.select("line", "place"), "line"), "asked")
    # the words of those lines, from their earliest places
    own = asked.groupBy("place.id", "place.key").agg(F.collect_list(F.struct("place.at", "line", "place")).alias("lines"))
    texts = docs.select(F.col(id_col).alias("t_id"), F.xxhash64(text_col).alias("t_key"), F.split(text_col, "\n", -1).alias("all_lines"))
    texts = texts.join(own, F.col("t_id").eqNullSafe(F.col("id")) & (F.col("t_key") == F.col("key")))
    known = texts.select("all_lines", F.explode("lines").alias("own")).select("own.line", "own.place", words_of(F.col("all_lines")[F.col("own.at")]).alias("words"))
    known = settle(known.groupBy("line").agg(F.first("place").alias("place"), F.first("words").alias("words")), "known")

    # a line also has to share all but one part with another: variants lack a word of that part
    part = _parts(known.select("line", F.array_join("words", " ").alias("text"), F.size("words").alias("n")))
    met = part.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    parts = part.join(met, "key", "left_semi").groupBy("line").agg(F.collect_set(F.struct("less", "low", "high")).alias("parts"))
    cut = known.join(parts, "line").select("line", "place", "words", F.explode("parts").alias("p"))
    size = F.size("words")
    gaps = F.when(size >= least_words, F.sequence(F.col("p.low") + 1, F.col("p.high") + F.col("p.less"))).otherwise(F.array().cast("array<int>"))
    kind = F.when(F.col("p.less") == 0, "replaced").otherwise("shorn")
    shorn = F.transform(gaps, lambda i: F.struct(kind.alias("kind"), i.alias("gap"), _hash(F.array_join(F.concat(F.slice("words", 1, i - 1), F.slice("words", i + 1, size)), " ")).alias("variant")))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.lit(0).alias("gap"), F.col("line").alias("variant")))
    variants = cut.select("line", "place", F.explode(F.when(F.col("p.less") == 0, F.concat(whole, shorn)).otherwise(shorn)).alias("v")).select("line", "place", "v.*")
    variants = settle(variants.distinct(), "variants")
    # replaced: both lack the word at one gap; inserted or deleted: one is the other's variant
    replaced = variants.where("kind = 'replaced'")
    by_gap = replaced.groupBy("variant", "gap").agg(F.min("place").alias("before"), F.count("*").alias("n")).where("n > 1")
    same = replaced.join(by_gap, ["variant", "gap"]).select("line", "place", "before")
    others = variants.where("kind <> 'replaced'")
    by_key = others.groupBy("variant").agg(F.min(F.when(F.col("kind") == "whole", F.col("place"))).alias("whole"), F.min(F.when(F.col("kind") == "shorn", F.col("place"))).alias("shorn")).where("whole is not null and shorn is not null")
    other = others.join(by_key, "variant").select("line", "place", F.when(F.col("kind") == "whole", F.col("shorn")).otherwise(F.col("whole")).alias("before"))
    met = same.unionByName(other).where("before < place").distinct()
    words = known.select("line", "words")
    earlier = known.select(F.col("place").alias("before"), F.col("words").alias("before_words"))
    near = met.join(words, "line").join(earlier, "before").where(within_one(F.col("words"), F.col("before_words"))).select("line").distinct()
    return classes.join(near, "line", "left_anti").select("place.id", "place.key", "place.at")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5) -> DataFrame:
    """All columns of ``docs``, the text without removed lines, with n_lines and n_removed (lines that are not blank).

    Lines are ordered by id (nulls last), text hash and place in the text; a line is removed if an
    earlier one is equal (white space aside) or near, whether or not that one stays itself. Blank
    lines are no copies and stay. A text all of whose lines go becomes empty, a null text stays null and has no lines.
    Rows that repeat both id and text are one text and share its fate. Columns of ``docs`` named
    n_lines or n_removed are replaced.
    """
    stay = kept_lines(docs, id_col, text_col, least_words).groupBy("id", "key").agg(F.collect_set("at").alias("__stay"))
    stay = stay.withColumnRenamed("id", "__id").withColumnRenamed("key", "__key")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*columns, F.xxhash64(text_col).alias("__own"))
    joined = rows.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    none = F.array().cast("array<int>")
    joined = joined.withColumn("__lines", F.split(text_col, "\n", -1)).withColumn("__stay", F.coalesce("__stay", none))
    has, lines = F.col(text_col).isNotNull(), F.col("__lines")
    blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~lines[i].rlike(r"[^\x20\x09-\x0D]"))
    total, left = F.size(lines) - F.size(blank), F.size("__stay")
    kept = F.array_join(F.transform(F.array_sort(F.concat("__stay", blank)), lambda i: lines[i]), "\n")
    text = F.when(has & (left < total), F.when(left == 0, F.lit("")).otherwise(kept)).otherwise(F.col(text_col))
    counted = joined.select(*columns, F.when(has, total).otherwise(0).cast("long").alias("n_lines"), F.when(has, total - left).otherwise(0).cast("long").alias("n_removed"), text.alias("__text"))
    return counted.withColumn(text_col, F.col("__text")).select(*columns, "n_lines", "n_removed")
