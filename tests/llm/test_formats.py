"""Chat formatting, the Merkle manifest and periodic runs against brute force: whole small tables, and odd rows."""

from __future__ import annotations

import random
from collections import defaultdict
from fractions import Fraction

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import chat, merkle, queries, runs  # noqa: F401
from shelfmark.registry import ORACLES, QUERIES

ODD_TEXTS = [
    None, "", " ", "\\", "\\\\", "[INST]", "[\\INST]", "\\[INST]", "[[INST]]", "<<<SYS>>>", "</s></s>", "a</s", ">x</s>\\", "[/INST][ANS]", "[ROLE]user[/ROLE]",
    "$0 $1 \\0", "line\nline\r\n", "日本 [INST] Über 😀 </s>", "[INST", "a\x00b", "x" * 200_000 + "</s>", "</s>[INST] ok [/INST]",
]


def turns(spark, rows):
    """Conversation rows beside columns of names that the operator uses inside."""
    return spark.createDataFrame([(*r, "1", "2", "3") for r in rows], "conv_id long, turn long, role string, text string, block string, segments string, id string")


def as_read(rows):
    """conv_id to its (role, text) in order."""
    out = defaultdict(list)
    low = lambda v: (v is not None, v or 0)
    for conv, _, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", r[3] or "")):
        out[conv].append((role or "", text or ""))
    return out


def check_chats(spark, rows):
    made = chat.format_chats(turns(spark, rows)).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.learnt_text(F.col("segments")).alias("learnt")).collect()
    want = as_read(rows)
    assert {r.conv_id: [tuple(t) for t in r.back] for r in made} == want
    for r in made:
        said = want[r.conv_id]
        assert r.n_turns == len(said) and "".join(s.text for s in r.segments) == r.formatted
        assert r.learnt == "".join(t for role, t in said if role == "assistant")
        assert r.valid == brute.chat_valid([role for role, _ in said])
        marks = {m: r.formatted.count(m) for m in chat.INSTRUCT.markers}
        assert marks["[ANS]"] == sum(role == "assistant" for role, _ in said)
        assert marks["[INST]"] == marks["[/INST]"] == sum(role == "user" for role, _ in said)
        assert marks["[ROLE]"] == sum(role not in ("system", "user", "assistant") for role, _ in said)


def test_chats_keep_every_odd_text(spark):
    rows = [(c, t, role, ODD_TEXTS[(c * 7 + t) % len(ODD_TEXTS)]) for c in range(len(ODD_TEXTS)) for t, role in enumerate(["user", "assistant"] * 2)]
    check_chats(spark, rows)


def test_chats_odd_rows(spark):
    rows = [
        (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s"), (1, 1, "assistant", "b"),  # repeats, a null turn
        (2, 5, None, None), (2, 6, "tool", "[/ROLE] x"), (2, 7, "[/ROLE]\\", "y"), (2, -3, "Assistant", "z"),  # roles the template lacks
        (None, 0, "user", "q"), (None, 1, "assistant", None), (3, 0, "assistant", "first"), (4, 0, "system", "s"), (4, 2**40, "user", "u"),
    ]
    check_chats(spark, rows)
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_chat_of_many_blocks_in_any_row_order(spark):
    rows = [(9, t, "assistant" if t % 2 else "user", f"t{t}</s>") for t in range(1000)]
    random.Random(3).shuffle(rows)
    check_chats(spark, rows)


def test_machine_names_the_first_turn_out_of_order(spark):
    orders = {1: "ua", 2: "sua", 3: "su", 4: "uaa", 5: "usa", 6: "uau", 7: "a", 8: "ssua", 9: "uaxua"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    rows = [(c, t, names[k], "x") for c, order in orders.items() for t, k in enumerate(order)]
    got = {r.conv_id: (r.valid, r.failed_at) for r in chat.format_chats(turns(spark, rows)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 2), 5: (False, 1), 6: (False, None), 7: (False, 0), 8: (False, 1), 9: (False, 2)}


def test_another_template_and_unsound_ones(spark):
    own = chat.Template(
        roles={"user": chat.Role("<|user|>", "<|end|>"), "bot": chat.Role("<|bot|>", "<|end|>", learnt=True)},
        moves=(("start", "user", "asked"), ("asked", "bot", "done"), ("done", "user", "asked")), ends=("done",),
        name_opening="<|name|>", name_closing="<|/name|>", closing="<|end|>", escape="~")
    rows = [(1, 0, "user", "~<|user|>~~<|<|end|>"), (1, 1, "bot", "<|bot|> \\ ~"), (1, 2, "x<|end|>", "<|/name|>")]
    made = chat.format_chats(turns(spark, rows), own).select("valid", chat.read_turns(F.col("formatted"), own).alias("back"), chat.learnt_text(F.col("segments"), own).alias("learnt")).first()
    assert [tuple(t) for t in made.back] == [r[2:] for r in rows] and made.learnt == rows[1][3] and not made.valid
    for bad in (dict(escape="|"), dict(closing="<"), dict(closing="user|><|a"), dict(name_opening="<|user|>"), dict(moves=(("start", "judge", "done"),))):
        with pytest.raises(ValueError):
            chat.Template(**{**own.__dict__, **bad})


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    made = QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(made.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in made.collect()))) == sorted(map(str, want)) and want


def test_chats_and_manifest_against_sql(spark, sf):
    same_as_sql(spark, sf, "op11_chat_format")
    same_as_sql(spark, sf, "op12_merkle_manifest")


def test_chat_query_has_the_control_conversation(spark, sf):
    row = QUERIES["op11_chat_format"](spark, sf).where("conv_id = -7").collect()
    text = "</s>[INST] ok [/INST]"
    assert [(r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in row] == [
        (2, brute.sha(f"user\n{text}\nassistant\n{text}\n"), len(text), brute.sha(text), True)]


def manifest_rows(spark, rows):
    """The manifest query's columns over rows beside columns of names that the operator uses inside."""
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, level string, i string, digest string, row string, n string, part string, steps string, `order` string"
    docs = spark.createDataFrame([(*[r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")], *"abcdefghi") for r in rows], schema)
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(docs, carry={"changed": merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)})
    made = made.withColumn("folded", merkle.fold(F.col("changed"), F.col("proof"))).withColumn("proof_sha256", F.sha2(merkle.siblings(F.col("proof")), 256))
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded", (F.col("folded") == F.col("root")).alias("verified")).collect()), key=repr)


def tampered(rows):
    return [{**r, "text": r["text"].replace("\n", "")} if r["doc_id"] is not None and r["text"] is not None and brute.crc(r["doc_id"]) % 2 == 0 else r for r in rows]


def rows_of(sizes, rng):
    out = [dict(doc_id=rng.randrange(10**6), source=s, lang=rng.choice(["en", None]), n_chars=rng.choice([None, 5]), text=rng.choice([None, "", "a\nb", "é\n", "plain", "z" * 50_000]))
           for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [
    {}, {"a": 1}, {None: 1}, {"a": 2}, {"a": 3, "b": 1}, {"a": 4, "": 9, None: 10, "é": 27, "Z": 28, "t": 1},
    {"hot": 800, "a": 243, "b": 244, "c": 81, "d": 82}, {f"s{k}": 1 + k % 3 for k in range(300)},
], ids=str)
def test_manifest_against_brute_force(spark, sizes):
    rows = rows_of(sizes, random.Random(len(sizes)))
    assert manifest_rows(spark, rows) == sorted(brute.merkle(rows, tampered(rows)), key=repr)


def test_manifest_odd_rows(spark):
    one = dict(doc_id=7, source="a", lang="en", n_chars=3, text="a\nb")
    rows = [one, one, one, {**one, "text": "other"}, {**one, "doc_id": None}, {**one, "doc_id": None}, {**one, "source": None}, {**one, "source": None, "text": None}, {**one, "source": ""}]
    assert manifest_rows(spark, rows) == sorted(brute.merkle(rows, tampered(rows)), key=repr)


def test_tampering_shows(spark, sf):
    made = QUERIES["op12_merkle_manifest"](spark, sf).collect()
    assert len({r.root for r in made}) == 1 and 0 < sum(not r.verified for r in made) < len(made)


def words_of(rng, n, kinds):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


def odd_word_lists():
    rng = random.Random(11)
    block = words_of(rng, 9, 1000)
    made = [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 100, (["a", "b"] * 12)[:23], ["a", "b"] * 12, block * 3, block * 3 + block[:4], (block * 3)[:-1]]
    made += [["x"] + block * 3 + ["y"] + block * 4, block * 3 + words_of(rng, 5, 1000) + block * 3, (["a"] * 30 + ["b"] * 30) * 4, (["a"] * 8 + ["b"]) * 6]
    made += [words_of(rng, rng.randrange(400), rng.choice([1, 2, 3, 20])) for _ in range(60)]
    for _ in range(60):  # runs of many periods inside noise, with a broken word here and there
        text = []
        for _ in range(rng.randrange(1, 6)):
            text += words_of(rng, rng.randrange(30), 50)
            part = words_of(rng, rng.randrange(1, 40), rng.choice([2, 50]))
            text += (part * rng.randrange(2, 8))[: rng.randrange(1, 200)]
            if rng.random() < 0.3:
                text[rng.randrange(len(text))] = "broken"
        made.append(text)
    long = words_of(rng, 7000, 100_000)
    return made + [long * 3, long[:200] * 50 + long[:333] * 10, words_of(rng, 20_000, 6)]


def check_runs(spark, lists, **given):
    rows = [(k, " \n".join(w)) for k, w in enumerate(lists)]
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed, r.n_words) for r in runs.find_runs(spark.createDataFrame(rows, "doc_id long, text string"), **given).collect()}
    for k, w in enumerate(lists):
        want, left = brute.periodic(w, **given)
        assert got[k] == (want, " ".join(left), len(w)), (k, want, got[k][0])


def test_runs_against_every_lag(spark):
    check_runs(spark, odd_word_lists())
    check_runs(spark, odd_word_lists()[:-3], least=40, repeats=4)
    check_runs(spark, odd_word_lists()[:-3], least=1, repeats=3)


def test_runs_whole_query(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        found, left = brute.periodic(brute.plant(brute.PLAIN.findall(text or ""), doc_id))
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if found else None
        assert got[doc_id] == (len(found), *best, milli, brute.sha("".join("%d,%d,%d\n" % r for r in found)), brute.sha(" ".join(left)))
        planted += bool(found) and brute.crc(doc_id) % 10 == 0
    assert planted


def test_runs_odd_rows(spark):
    rows = [(None, None), (1, None), (1, ""), (2, " \t\n"), (3, "a " * 24), (3, "a " * 24), (None, "b\x0b" * 30), (4, "\xa0".join("c" * 30)), (5, "\x1c " * 24)]
    docs = spark.createDataFrame([(*r, "1", "2", "3", "4") for r in rows], "doc_id long, text string, runs string, c0 string, t string, `a.b` string")
    made = runs.find_runs(docs)
    assert made.columns == ["doc_id", "c0", "t", "a.b", "n_words", "runs", "collapsed"]
    got = sorted(str((r.doc_id, r.c0, r["a.b"], [tuple(x) for x in r.runs], r.collapsed)) for r in made.collect())
    want = [(i, "2", "4", *(lambda f: (f[0], " ".join(f[1])))(brute.periodic(brute.PLAIN.findall(t or "")))) for i, t in rows]
    assert got == sorted(map(str, want))
    assert runs.find_runs(docs.where("false")).count() == 0
    assert runs.find_runs(docs.select("text")).count() == len(rows)
    with pytest.raises(ValueError):
        runs.find_runs(docs, repeats=2)


def test_planting_leaves_null_ids_and_empty_texts(spark):
    rows = [(None, "a b c"), *[(k, t) for k in range(40) for t in (None, "", " ", "one", " ".join(f"w{j}" for j in range(97)))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, r.t) for r in docs.select("*", runs.planted(F.col("text"), F.col("doc_id")).alias("t")).collect()]
    for doc_id, text, made in got:
        assert (made is None) == (text is None)
        assert brute.PLAIN.findall(made or "") == brute.plant(brute.PLAIN.findall(text or ""), doc_id)


def test_longest_run_is_compared_exactly(spark):
    rows = [(1, [(0, 30, 7), (40, 24, 3), (70, 48, 6)]), (2, []), (3, [(5, 10**9 + 1, 10**8), (9, 10**9 + 2, 10**8)])]
    docs = spark.createDataFrame(rows, "id long, runs array<struct<start:long,length:long,period:long>>")
    got = {r.id: r.b and tuple(r.b) for r in docs.select("id", runs.longest_run(F.col("runs")).alias("b")).collect()}
    assert got == {1: (40, 24, 3), 2: None, 3: (9, 10**9 + 2, 10**8)}
