"""The queries of this subpackage over the tables of a folder, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import chat, impact_index, langid, minhash, packing, pii, piece_codec, runs, sharding, spotsigs, topk, toxicity, warc
from quirefold.llm.common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def hex_of(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and decoded text of every document, by the hashes of both. A null text is empty; rows that repeat an id or a text are coded
    each; an empty table gives no rows; columns but doc_id and text aren't read."""
    from public_tokenizers import path

    model = path("piece_bpe_32k.model")
    coded = piece_codec.encode_and_decode(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_of(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        hex_of(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents alike by 85 per cent or more. Nulls, empty texts and repeated ids: see minhash. An empty table gives no
    rows; columns but doc_id and text aren't read."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), similarity=85)


def crc_mod(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


TOXIC = 0.7


@query
def op10_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from rows whose remainder isn't 1. Nulls, repeated ids and labels that disagree: see toxicity.
    An empty table, or one without toxic labels, gives scores next to 0; columns but doc_id and text aren't read."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=crc_mod(3) != 1)
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query
def op7_word_first_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from rows whose remainder isn't 0. Nulls, ties and repeated rows: see langid. An empty
    table gives no rows; columns but doc_id, text and lang aren't read."""
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, train=crc_mod(5) != 0), keep=["doc_id"])
    return found.select("doc_id", (crc_mod(5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text. Nulls, repeated ids and ties: see spotsigs. An empty table gives no rows; other
    columns are dropped first."""
    rows = spotsigs.with_next(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = rows.withColumn("edited", spotsigs.edited(F.col("text"), F.col("next_text")))
    rows = spotsigs.with_signatures(rows, F.col("edited"), "edited_sigs")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        hex_of(F.col("edited")).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


@query
def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of highest inner product for every vec_id that 20 divides. Nulls, ties and repeated ids: see topk. An empty table gives
    no rows; columns but vec_id and embedding aren't read."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back, as an index in order. Nulls and repeated pages: see warc. An empty table gives no
    rows; columns but page_id, url and html aren't read, whatever their names."""
    path = f"{shared_dir(spark)}/archives/{spark.sparkContext.applicationId}-{md5(sf_dir.encode()).hexdigest()}"
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    index = warc.merged_index(warc.read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "part", "seq")


@query
def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards, under the law `bytes`. Nulls, ties and repeated rows: see sharding. An empty table gives no
    rows; columns but doc_id and text aren't read."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in bins, under conflicts of sources and of clusters of near copies. Nulls, repeated ids and long texts: see packing. An
    empty table gives no rows; columns but doc_id, text and source aren't read."""
    docs = table(spark, sf_dir, "documents")
    return packing.best_fit(docs, near=packing.near_clusters(docs))


@query
def op11_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every item of the benchmark. Nulls, ties and repeated rows: see impact_index."""
    return impact_index.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query
def op12_disclosed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data, and of terms that disclose it, in every document. Nulls, repeated rows and long texts: see pii."""
    found = pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def said(spans) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS if k != "term"]
    return found.select("doc_id", *counts, hex_of(said(F.filter("spans", lambda s: s.kind != "term"))).alias("base_sha256"), said(F.col("spans")).alias("spans"))


@query
def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document, a tenth of which get one planted. Nulls and long texts: see runs."""
    found = runs.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.period")).alias("period"),
        F.expr("-1000 * longest.length div longest.period").alias("exponent_milli"),
        hex_of(F.array_join(lines, "")).alias("runs_sha256"),
        hex_of(F.col("collapsed")).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the texts, by a hash of the id, all words from one on repeat a stretch of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != ""))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    rows = rows.withColumn("a", F.expr("g % nullif(size(words), 0)"))
    rows = rows.withColumn("p", F.expr("1 + (size(words) - a) div (3 + g % 8)"))
    repeated = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, get(words, cast(a + (i - a) % p as int)))), ' ')")
    return rows.select("doc_id", F.when(F.size("words") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each speaker. Nulls, repeated turns and hot conversations: see chat. An empty table gives no rows;
    columns but conv_id, turn, role and text aren't read, whatever their names."""
    views = chat.perspectives(table(spark, sf_dir, "conversations"))
    masks = F.array_join(F.transform("masks", lambda m: F.concat(m.start.cast("string"), F.lit("-"), m.end.cast("string"))), ",")
    return views.select("conv_id", "speaker", "part", "n_turns", "text", masks.alias("masks"), "char_offset")


SQL["op1_perspectives"] = f"""
with t as (
  select conv_id, turn, floor(turn / {chat.TURNS}) as range, replace(coalesce(role, 'unknown'), '<|', '< |') as name,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) as body
  from conversations
), people as (select distinct conv_id, name as self from t where name <> 'system'
), said as (
  select t.*, self, case when name = self then '<|assistant|>' when name = 'system' then '<|system|>'
                         else '<|user:' || name || '|>' end || chr(10) as head
  from t join people on t.conv_id is not distinct from people.conv_id
), placed as (
  select *, coalesce(sum(length(head) + length(body)) over (partition by conv_id, self, range order by turn
                     rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from said
), parts as (
  select conv_id, self, range, count(*) as n_turns, string_agg(head || body, '' order by turn) as text,
         coalesce(string_agg((start + length(head))::varchar || '-' || (start + length(head) + length(body))::varchar, ','
                             order by turn) filter (where name = self), '') as masks
  from placed group by all
)
select conv_id, self as speaker, (row_number() over (partition by conv_id, self order by range) - 1)::int as part,
       n_turns::int as n_turns, text, masks,
       coalesce(sum(length(text)) over (partition by conv_id, self order by range
                rows between unbounded preceding and 1 preceding), 0)::bigint as char_offset
from parts
"""

SQL["op5_mtree_topk"] = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor({topk.SCALE} * x::double)) as whole
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.whole, c.whole, true), lambda z: z[1] * z[2])), 0)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"""

SQL["op11_impact_index"] = f"""
with d as (select row_number() over () as row, doc_id, {_TERMS} as terms from documents
), said as (select row, doc_id, len(terms) as n, unnest(terms) as term from d
), tf as (select row, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*) as tf from said group by row, term
), totals as (select count(*) filter (len(terms) > 0)::bigint as docs, sum(len(terms))::bigint as terms from d
), weights as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by term, docs
), asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark
), scored as (
  select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from asked join weights using (term) join tf using (term), totals group by item_id, row, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select * from ranked where rank <= 50
"""

#: The CRC-32 of the digits of an id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(str_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL["op13_harmonic_runs"] = f"""
with d as (
  select row_number() over () as row, doc_id, coalesce({_CRC}, 1) as h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), a as (select *, len(words) as n, h // 10 as g, case when h % 10 = 0 and len(words) > 0 then (h // 10) % len(words) end as a from d
), p as (select *, 1 + (n - a) // (3 + g % 8) as p from a
), w as (
  select row, n, unnest(range(n)) as i, unnest(case when a is null then words else list_transform(range(n), lambda i: words[1 + case when i < a then i else a + (i - a) % p end]) end) as word from p
), same as (
  select x.row, x.i, y.i - x.i as q from w x join w y on x.row = y.row and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), islands as (select *, i - row_number() over (partition by row, q order by i) as island from same
), stretches as (select row, q, min(i) as start, count(*) + q as length from islands group by row, q, island
), r as (select row, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by row, start, length
), summed as (
  select row, count(*) as n_runs, max((length, -start, -period)) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines
  from r group by row
), kept as (
  select row, string_agg(word, ' ' order by i) as collapsed from w
  where not exists (select 1 from r where r.row = w.row and w.i >= r.start + r.period and w.i < r.start + r.length) group by row
)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-best[2])::bigint as start, best[1]::bigint as length, (-best[3])::bigint as period,
       (1000 * best[1] // -best[3])::bigint as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from d left join summed using (row) left join kept using (row)
"""
