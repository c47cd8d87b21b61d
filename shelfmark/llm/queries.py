"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmark.llm import chat, contamination, lines, merkle, pages, private, runs, sentence_pieces, simhash, substrings, token_counts, toxicity, vectors
from shelfmark.registry import query


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, folder, "documents"), size=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op2_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_vectors(table(spark, folder, "embeddings"), threshold=0.95)


@query("op3_line_dedup")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query("op4_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), size=13, one_in=20)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_sentence_pieces")
def sentence_piece_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    made = sentence_pieces.encode_pieces(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return made.select("doc_id", "n_tokens", "token_ids", "parity", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"), distance=2, shingle=3)


@query("op7_private_data")
def private_data(spark: SparkSession, folder: str) -> DataFrame:
    found = private.find_private(table(spark, folder, "documents"))
    counts = [F.size(F.filter(F.col("base")["kind"], lambda k: k == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in private.KINDS]
    return found.select("doc_id", *counts, F.sha2(private.spans_text("base"), 256).alias("base_sha256"), private.spans_text("spans").alias("spans"))


@query("op8_token_counts")
def token_count(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_toxicity")
def toxicity_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query("op10_page_text")
def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_pages(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


#: Both turns of conversation -7 say this.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op11_chat_format", """
with turns as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed as (
    select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
        count(*) over (partition by conv_id) as n
    from turns
), sized as (
    select *, case
            when role = 'system' then place = 1
            when role = 'user' then place = 1 or before in ('system', 'assistant')
            when role = 'assistant' then before = 'user'
            else false end and (place < n or role = 'assistant') as fits,
        case role when 'system' then 15 when 'user' then 13 when 'assistant' then 9 else 17 end as marks,
        list_sum(list_transform(
            ['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '[ANS]', '[ROLE]', '[/ROLE]', '</s>'],
            lambda m: (length(text) - length(replace(text, m, ''))) // length(m))) + length(text) - length(replace(text, chr(92), '')) as added,
        case when role in ('system', 'user', 'assistant') then 0 else length(role) end as named
    from placed
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(text) + added + marks + named) as bigint) as formatted_chars,
    bool_and(fits) as valid
from sized group by conv_id
""")
def chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    control = spark.sql("select -7L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(CONTROL_TEXT))
    made = chat.format_chats(given.select("conv_id", "turn", "role", "text").unionByName(control))
    back = made.select("conv_id", "formatted", "valid", chat.read_turns(F.col("formatted")).alias("turns"), chat.learnt_text(F.col("segments")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


_MERKLE_SQL = """
with recursive crcs as (
    select doc_id, list_reduce(list_concat([4294967295::ubigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k::int, 1))::ubigint)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]),
            lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)) as flipped
    from (select distinct doc_id from documents)
), rows as (
    select d.doc_id, d.source, d.text,
        case when d.doc_id is null then '-' else strlen(d.doc_id::varchar) || ':' || d.doc_id end
            || case when d.source is null then '-' else strlen(d.source) || ':' || d.source end
            || case when d.lang is null then '-' else strlen(d.lang) || ':' || d.lang end
            || case when d.n_chars is null then '-' else strlen(d.n_chars::varchar) || ':' || d.n_chars end as head,
        coalesce(xor(flipped, 4294967295::ubigint) % 2 = 0, false) as tampers
    from documents d left join crcs c on d.doc_id is not distinct from c.doc_id
), leaves as (
    select doc_id, source, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
        case when not tampers then sha256(head || case when text is null then '-' else strlen(text) || ':' || text end)
            else sha256(head || case when text is null then '-' else strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') end) end as changed
    from rows
), numbered as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from leaves
), low as (
    select coalesce('s' || source, 'n') as tree, 0 as lvl, i, leaf as digest, n from numbered
    union all
    select tree, lvl + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from low where n > 1 group by tree, lvl, i // 3, n
), subroots as (
    select tree, digest, row_number() over (order by tree) - 1 as i, count(*) over () as n from low where n = 1
), high as (
    select 0 as lvl, i, digest, n from subroots
    union all
    select lvl + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from high where n > 1 group by lvl, i // 3, n
), all_nodes as (
    select tree, lvl, i, digest, n from low union all select 't', lvl, i, digest, n from high
), steps as (
    select tree, lvl, i, n,
        coalesce(lag(digest, 2) over w, '') || coalesce(lag(digest, 1) over w, '') as before,
        coalesce(lead(digest, 1) over w, '') || coalesce(lead(digest, 2) over w, '') as behind
    from all_nodes window w as (partition by tree, lvl, i // 3 order by i)
), walk as (
    select row_number() over () as leaf_row, coalesce('s' || source, 'n') as own, coalesce('s' || source, 'n') as tree, 0 as lvl, i, n, doc_id, leaf, changed as folded, '' as proof from numbered
    union all
    select w.leaf_row, w.own,
        case when w.n > 1 then w.tree else 't' end,
        case when w.n > 1 then w.lvl + 1 else 0 end,
        case when w.n > 1 then w.i // 3 else u.i end,
        case when w.n > 1 then (w.n + 2) // 3 else u.n end, w.doc_id, w.leaf,
        case when w.n > 1 then sha256(s.before || w.folded || s.behind) else w.folded end,
        case when w.n > 1 then w.proof || s.before || s.behind else w.proof end
    from walk w join steps s on s.tree = w.tree and s.lvl = w.lvl and s.i = w.i left join subroots u on u.tree = w.tree
    where not (w.tree = 't' and w.n = 1)
)
select doc_id, leaf, u.digest as subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = r.digest as verified
from walk w join subroots u on u.tree = w.own, (select digest from high where n = 1) r
where w.tree = 't' and w.n = 1
"""


@query("op12_merkle_manifest", _MERKLE_SQL)
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(tampers, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(
        table(spark, folder, "documents"), carry={"changed": merkle.digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], changed)})
    folded = found.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    best = runs.longest_run(F.col("runs"))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = runs.find_runs(docs, least=24, repeats=3).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
