"""Operators on documents against brute force: whole small tables, and odd rows."""

from __future__ import annotations

import random
import re

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F, types as T

from shelfmark.llm import contamination, lines, private, queries, sentence_pieces, similar, simhash, substrings, token_counts
from shelfmark.registry import QUERIES

#: Columns whose names the operators use inside.
CLASH = [("chunk", "7"), ("key", "x"), ("fp", "y"), ("words", "z"), ("place", "q"), ("base", "w"), ("n", "3"), ("hashes", "h")]


def frame(spark, rows, kind="long", clash=True):
    more = CLASH if clash else []
    schema = T.StructType([T.StructField("doc_id", T.LongType() if kind == "long" else T.StringType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c, _ in more]])
    return spark.createDataFrame([(i, t, *[v for _, v in more]) for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    words = [f"w{k}" for k in range(12)] + ["Über", "İx", "日本", "a.b", "!!"]
    run = " ".join(rng.choice(words) for _ in range(60))
    long = " ".join(rng.choice(words) + str(rng.randrange(5)) for _ in range(30_000))
    return [None, "", " \n\t ", "one", "two words", run, run, run.upper(), "x " + run + " y", run + " " + run, long, long + " tail", " nb sp \x1c", "a\x00b c", "x" * 5000]


ODD = list(enumerate(odd_texts())) + [(3, "one"), (None, "one"), (None, None), (None, "")]


def test_substrings_whole(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op1_substring_dedup"](spark, sf).collect()}
    assert got == dict(zip([i for i, _ in docs], brute.substrings([t for _, t in docs])))


def test_substrings_odd(spark):
    made = substrings.dedup_substrings(frame(spark, ODD), size=7, chunk_bytes=4096, bucket_windows=512).collect()
    want = sorted(map(str, [(i, *x) for (i, _), x in zip(ODD, brute.substrings([t for _, t in ODD], 7))]))
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, brute.sha(r.kept_text))) for r in made) == want
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in made)


def test_substrings_copies_and_overlap(spark):
    rows = [(1, "a b c d e"), (2, "z b c d y"), (3, "q q q q"), (4, "c d e")]
    got = {r.doc_id: (r.kept_text, [tuple(s) for s in r.removed]) for r in substrings.dedup_substrings(frame(spark, rows), size=3).collect()}
    assert got == {1: ("a", [(1, 5)]), 2: ("z y", [(1, 4)]), 3: ("", [(0, 4)]), 4: ("", [(0, 3)])}


def test_contamination_whole(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op4_benchmark_decontamination"](spark, sf).collect()}
    want = brute.contamination([t for _, t in docs], items)
    assert got == {i: (w, h, len(ids), brute.sha(",".join(ids)), c) for (i, _), (w, h, ids, c) in zip(docs, want)}


@pytest.mark.parametrize("shard_rows", [200_000, 5])
def test_contamination_odd(spark, shard_rows):
    items = [(10, "w1 w2"), (9, "ONE"), (9, "one"), (None, "w3"), (4, None), (5, " ,. "), (6, ODD[5][1][:80]), (7, "日本"), (70, "日本")]
    known = spark.createDataFrame(items, "item_id long, text string")
    made = contamination.find_contamination(frame(spark, ODD), known, size=6, shard_rows=shard_rows).collect()
    want = sorted(map(str, [(i, *x) for (i, _), x in zip(ODD, brute.contamination([t for _, t in ODD], items, 6))]))
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated)) for r in made) == want
    assert made[0].chunk == "7"


def test_simhash_whole(spark, sf, docs):
    marks = [brute.fingerprint(t) for _, t in docs]
    order = sorted(range(len(docs)), key=lambda k: docs[k][0])
    found = brute.groups(len(order), lambda a, b: (marks[order[a]] ^ marks[order[b]]).bit_count() <= 2)
    want = {docs[order[k]][0]: (f"{marks[order[k]]:016x}", docs[order[g]][0]) for k, g in enumerate(found)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash_near_dedup"](spark, sf).collect()} == want


def test_simhash_odd(spark):
    made = simhash.simhash_components(frame(spark, ODD)).collect()
    assert len(made) == len(ODD)
    zero = [r for r in made if r.fingerprint == "0" * 16]
    assert len(zero) == 5 and {r.component_id for r in zero} == {0}
    kept = simhash.drop_near_documents(frame(spark, ODD)).collect()
    assert len(kept) == len({r.component_id for r in made}) and kept[0].chunk == "7"
    assert all(r.doc_id is not None for r in kept)


@pytest.mark.parametrize("group", [4096, 3])
def test_fingerprint_links_connect_all_near(spark, group):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(8)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    want = brute.groups(len(values), lambda a, b: ((values[a] ^ values[b]) & (1 << 64) - 1).bit_count() <= 2)
    links = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in values], "fp long"), 2, group=group).collect()
    at = {v: k for k, v in enumerate(values)}
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    pairs = {(max(at[r.u], at[r.v]), min(at[r.u], at[r.v])) for r in links}
    assert brute.groups(len(values), lambda a, b: (a, b) in pairs) == want


def test_thresholds():
    assert simhash.allocate([{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 2, 1: 3}], 1) == (8, [0, 1])
    assert simhash.allocate([{-1: 0, 0: 5}, {-1: 0, 0: 2}, {-1: 0, 0: 3}], -1) == (5, [-1, 0, 0])


def test_lines_whole(spark, sf, docs):
    got = {(r.doc_id, r.text) for r in QUERIES["op3_line_dedup"](spark, sf).collect()}
    some = docs[:60]
    want = brute.lines(some)
    made = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, some)).collect()}
    assert made == {i: want[i, t] for i, t in some}
    assert len(got) == len(docs)


def test_lines_odd(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdef") * 3 for _ in range(n)) for n in (4, 5, 5, 6, 9, 30, 31)]
    rows: list[tuple] = []
    for i in range(40):
        own = []
        for line in rng.sample(base, 3):
            w = line.split()
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [rng.choice("abcdef") * 3] * rng.randrange(2)
            own.append(("  " if rng.random() < 0.3 else "") + " ".join(w) + ("\t" if rng.random() < 0.3 else ""))
        rows.append((i, "\n".join([*own, ""] if i % 3 else ["", *own])))
    rows += [(50, None), (51, ""), (52, "\n \n"), (None, base[0]), (None, "fresh line"), (60, "\n".join(f"line {k} of a very long text here" for k in range(3000)))]
    rows.append(rows[4])
    want = brute.lines(rows)
    made = lines.dedup_lines(frame(spark, rows)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in made])) == sorted(map(str, [(i, want[i, t]) for i, t in rows]))
    assert all(r.n_removed <= r.n_lines for r in made) and made[0].words == "z"


PII = [
    "mail a.b+c@d-e.co.uk, or x@y and p@q.r_s@t.u!", "10.0.0.255 999.1.1.1 1.2.3.4.5.6.7.8 00.000.0.0255", "4111 1111 1111 1111 and 4111-1111-1111-1112 12 34", "+1 (456) 555-2186. +12 +1-2 +44 20 7946 0958)",
    "😀 +49 30 1234567 é a@b.c 日本1.2.3.4", "5 5 " * 4000, "1" * 30_000, "a" * 30_000 + "@", None, "", "@ + . 1", "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1",
]


def test_private_whole(spark, sf, docs):
    for r in QUERIES["op7_private_data"](spark, sf).collect():
        found = brute.private(dict(docs)[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in found) for k in private.KINDS)
        assert r.base_sha256 == brute.sha(shown)
        assert set(filter(None, shown.split(","))) <= set(r.spans.split(","))


def test_private_odd(spark):
    rows = [*enumerate(PII), (3, PII[3]), (None, PII[0])]
    made = private.find_private(frame(spark, rows)).collect()
    want = sorted(str((i, brute.private(t))) for i, t in rows)
    assert sorted(str((r.doc_id, [(s.kind, s.start, s.end) for s in r.base])) for r in made) == want


def test_private_contexts_find_more(spark):
    rows = [(i, f"please call hotline +1 (456) 555-2{i:03d} today for help") for i in range(60)]
    rows += [(100, "please call hotline 0456-555-2186 today for help"), (101, "the number 0456-555-2187 is no hotline")]
    made = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in private.find_private(frame(spark, rows)).collect()}
    assert made[100] == [("phone", "0456-555-2186")] and made[101] == []


def test_private_at_the_edges(spark):
    rows = [(i, f"my account +1 (456) 555-2{i:03d}") for i in range(30)] + [(i, f"+1 (456) 555-3{i:03d} is mine") for i in range(40, 70)]
    rows += [(100, "my account 9912-4471"), (101, "9912-4472 is mine"), (102, "9912-4473"), (103, "no place 9912-4474")]
    made = {r.doc_id: [(s.kind, s.value) for s in r.spans] for r in private.find_private(frame(spark, rows)).collect()}
    assert [made[i] for i in range(100, 104)] == [[("phone", "9912-4471")], [("phone", "9912-4472")], [], []]


def test_private_spaced_groups(spark):
    rows = [(i, f"please call hotline +1 (456) 555-2{i:03d} today for help") for i in range(60)]
    rows += [(100, "please call hotline 99 12 44 71 today for help"), (101, "in 99 12 44 72 cases"), (102, "call 9 99 or hotline 9912 44 today or +1 (456) 555-2186 7")]
    made = {r.doc_id: [(s.kind, s.start, s.value) for s in r.spans] for r in private.find_private(frame(spark, rows)).collect()}
    assert made[100] == [("phone", 20, "99 12 44 71")] and made[101] == [] and [s[2] for s in made[102]] == ["9912 44", "+1 (456) 555-2186 7"]


def test_token_counts(spark, sf, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    more = ["x<|endoftext|>y", "<|endoftext|>", " <|endoftext|> ", "a \n b", "a\n b", "a  b", "it's I'll 's", "a\x1c b", "a \x85b", " lead", "trail ", "\r\n a\r\n", "\n\nx\n", "\nx", "x\n", "日本 語　x   y", " ".join(f"n{k}" for k in range(20_000))]
    rows = [*ODD, *enumerate(more, 100)]
    for frequent in (token_counts.FREQUENT, 0):
        made = token_counts.count_tokens(frame(spark, rows), path, frequent=frequent).collect()
        want = sorted(str((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False)))) for i, t in rows)
        assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in made) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in made)
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, sf).collect()}
    assert got == {i: len(e) for (i, _), e in zip(docs, tokenizer.encode_batch([t or "" for _, t in docs], add_special_tokens=False))}


def test_sentence_pieces(spark, sf, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = ["  a  b ", "\n\n x", "▁a ▁", " " * 40 + "x", "<s>hi</s><0x0A>", "日本語 😀\x00é", "aaa " * 50, "\n", " ", "x\n y"]
    rows = [*ODD, *enumerate(more, 100)]
    made = sentence_pieces.encode_pieces(frame(spark, rows), path)
    found = made.collect()
    want = sorted(str((i, library.encode(t or ""), library.decode(library.encode(t or "")))) for i, t in rows)
    assert sorted(str((r.doc_id, list(r.token_ids), r.decoded)) for r in found) == want
    assert all(r.parity and r.n_tokens == len(r.token_ids) for r in found)
    again = sentence_pieces.decode_pieces(made.drop("decoded"), path).collect()
    assert sorted(str((r.doc_id, r.decoded)) for r in again) == sorted(str((r.doc_id, r.decoded)) for r in found)
    whole = QUERIES["op5_sentence_pieces"](spark, sf).collect()
    assert all(r.round_trip and r.parity for r in whole) and len(whole) == len(docs)


def _message(*fields: tuple[int, object]) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    import struct

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(raw)) + raw
    return out


def test_unigram_model():
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *[(f"<0x{k:02X}>", 0.0, 6) for k in range(256)]]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("▁a", -1.5), ("a", -3.0), ("b", -3.1), ("ab", -2.5), ("▁ab", -4.0), ("ba", -2.7), ("bab", -3.3), ("c", -5.0)]]
    data = _message(*[(1, _message((1, p), (2, s), (3, k))) for p, s, k in pieces], (2, _message((3, 1), (35, 1))), (3, _message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    coder = sentence_pieces.Coder(data)
    texts = ["ab abab  ba", "c a", "é bab", "", "abababab"]
    assert coder.encode(texts)[0] == [library.encode(t) for t in texts]
    assert coder.decode(coder.encode(texts)[0]) == [library.decode(library.encode(t)) for t in texts]


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert substrings.dedup_substrings(none).count() == 0
    assert contamination.find_contamination(none, items).count() == 0
    assert contamination.find_contamination(frame(spark, ODD), items).where("contaminated").count() == 0
    assert simhash.simhash_components(none).count() == 0 and simhash.drop_near_documents(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert private.find_private(none).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert sentence_pieces.encode_pieces(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_native_plans(spark, sf):
    for name in ("op3_line_dedup", "op7_private_data"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    assert queries.table(spark, sf, "documents").columns


def _sets(rows, size=5):
    words = {i: brute.PLAIN.findall(brute.low(t)) for i, t in rows}
    return {i: {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set() for i, w in words.items()}


def test_similar_documents(spark):
    """Of each pair at 0.8 or more one goes; what goes is near something; blocks find the same."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for group in range(12):
        base = [word() for _ in range(rng.randrange(60, 400))]
        for copy in range(rng.choice((1, 2, 8, 60))):
            own = list(base)
            for _ in range(copy and max(1, len(own) // 150)):
                own[rng.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, key int")
    kept = {r.doc_id for r in similar.drop_similar(docs).collect()}
    sets = _sets(rows)
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = [(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.8]
    assert near and not [p for p in near if p[0] in kept and p[1] in kept]
    assert all(any(alike(i, o) >= 0.7 for o in sets if o != i) for i in set(sets) - kept) and len(kept) >= 12
    fps = similar.fingerprints(docs, "doc_id", "text", 5).select(*similar.PARTS).distinct()
    sure, limit = similar.limits_for(0.8)
    plain, cut = ({(r.u, r.v) for r in similar.components(similar.link_similar(fps, sure, limit, block=b), "u", "v").withColumnsRenamed({"node": "u", "component": "v"}).collect()} for b in (4096, 7))
    assert plain == cut


def test_similar_odd(spark):
    made = similar.drop_similar(frame(spark, ODD)).collect()
    texts = [brute.low(r.text).split() for r in made]
    assert sum(not t for t in texts) == 1 and len({tuple(t) for t in texts}) == len(texts)
    assert similar.drop_similar(frame(spark, ODD).limit(0)).count() == 0


def _alike(a, b):
    return len(a & b) / len(a | b)


def _edited(rng, base, edits):
    own = list(base)
    for at in rng.sample(range(len(own)), edits):
        own[at] = "".join(rng.choice("abcdefghij") for _ in range(6))
    return own


def test_similar_recall(spark):
    """Pairs at 0.80 to 0.85, texts of 5 to 400 shingles: every one is found."""
    rng, rows, pairs = random.Random(8), [], []
    while len(pairs) < 300:
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.choice((8, 14, 30, 55, 105, 205, 404)))]
        own = base + _edited(rng, base, 1)[-1:] if len(base) < 10 else _edited(rng, base, rng.randint(1, max(1, len(base) // 35)))
        pair = [" ".join(base), " ".join(own)]
        if 0.8 <= _alike(*_sets(enumerate(pair)).values()) <= 0.85:
            pairs.append((len(rows), len(rows) + 1))
            rows += enumerate(pair, len(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in similar.drop_similar(docs).collect()}
    assert [p for p in pairs if set(p) <= kept] == [] and kept == {a for a, _ in pairs}


def test_similar_below(spark):
    """Texts whose nearest is at 0.70 to 0.79 stay."""
    rng, rows = random.Random(4), []
    while len(rows) < 800:
        base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(rng.choice((30, 55, 105)))]
        pair = [" ".join(base), " ".join(_edited(rng, base, len(base) // 28))]
        if 0.7 <= _alike(*_sets(enumerate(pair)).values()) < 0.8:
            rows += enumerate(pair, len(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert similar.drop_similar(docs).count() == len(rows)


def test_similar_large_group(spark):
    """Over 32 edited copies of one text meet everywhere: the first of each group that links of 0.8 or more make stays."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(150)]
    rows = [(i, " ".join(_edited(rng, base, rng.randint(2, 6)))) for i in range(150)]
    sets = _sets(rows)
    root = brute.groups(len(rows), lambda a, b: _alike(sets[a], sets[b]) >= 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in similar.drop_similar(docs).collect()} == set(root)


def test_evened_lines_hold_the_words_of_the_line(spark):
    """Front, back and number of words of a line come from its evened text, without cutting most lines into arrays."""
    odd = ["a b c d e", "  a  b\tc ", "x  y ", "ä b c", "one", " \u0085 q\x0bz", "w " * 40, " ".join("abcdefghijklmnopqrs"), "e f  "]
    text = lines.even(F.col("line"))
    rows = spark.createDataFrame([(x,) for x in odd], "line string").select("line", text.alias("text"), lines._count(text).alias("n"))
    made = rows.select("*", lines._front(F.col("text"), F.col("n") - 1).alias("front"), lines._front(F.col("text"), 1 - F.col("n")).alias("back"))
    for r in made.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r.line) if w]
        assert (r.text, r.n, r.front, r.back) == (" ".join(words), len(words), " ".join(words[:-1]), " ".join(words[1:]))
