"""The registered queries of the data pipeline operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chat_format, decontaminate, jaccard_join, line_dedup, packing, pii, quality_model, quality_rules, secret_scan, token_store
from plumbline.llm.core import scratch


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def op1_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.train(docs, labels, may_learn=~held_out())
    scored = quality_model.score_ids(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch(spark, "tokens")
    token_store.write_tokens(docs, path, tokenizer_path(), end_id=0)
    read = token_store.read_documents(token_store.lookup(docs, path), path, with_ids=False)
    return read.select(F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024, 2, with_ids=False)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    w = chat_format.read_windows(chat_format.format_conversations(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    w = w.select("conv_id", F.struct("window", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), "chars")
    # the digests need a conversation's windows together, in order
    g = w.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = lambda x: F.array_join(F.transform("w", lambda w: w[x]), "")
    digest = lambda x: F.sha2(whole(x).cast("binary"), 256)
    return g.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length(whole("loss")).cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")


def op10_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), "emptied", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pairwise_quality": op1_pairwise_quality,
    "op2_token_store": op2_token_store,
    "op4_secret_scan": op4_secret_scan,
    "op9_quality_rules": op9_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op3_parity_join": op3_parity_join,
    "op8_chat_format": op8_chat_format,
    "op10_context_pii": op10_context_pii,
    "op7_best_two_fit": op7_best_two_fit,
    "pipeline": corpus_pipeline.run,
}
#: The words of a text, in DuckDB's SQL.
_WORDS = "regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op3_parity_join": f"""with recursive w as (select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
  s as (select distinct doc_id, unnest(case when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], chr(1))) when len(ws) > 0 then [array_to_string(ws, chr(1))] else [] end) as g from w),
  n as (select doc_id, count(*) as n from s group by 1),
  p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
  l as (select u, v from p join n a on a.doc_id = u join n b on b.doc_id = v where 100 * c >= 85 * (a.n + b.n - c)),
  e as (select u, v from l union all select v, u from l),
  r as (select doc_id as node, doc_id as seen from w union select r.node, e.v from r join e on e.u = r.seen)
  select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.seen) as component_id from w left join n using (doc_id) join r on r.node = w.doc_id group by w.doc_id""",
    "op5_line_dedup": f"""with x as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
  l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from x where text is not null),
  w as (select doc_id, i, {_WORDS.format("line")} as ws from l),
  o as (select *, row_number() over (order by doc_id, i) as ord from w where len(ws) >= 1),
  f as (select ws, min(ord) as ord from o group by ws),
  v as (select ord, k, list_concat(ws[1:k - 1], ws[k + 1:]) as rest from (select ord, ws, unnest(range(1, len(ws) + 1)) as k from f where 1 <= 0.2 * len(ws))),
  near as (select distinct ord from (select ord, min(ord) over (partition by k, rest) as m from v) where m < ord
           union select v.ord from v join f on f.ws = v.rest and f.ord < v.ord
           union select f.ord from f join v on f.ws = v.rest and v.ord < f.ord),
  g as (select o.doc_id, o.i from o join f on o.ws = f.ws where o.ord > f.ord or o.ord in (select ord from near)),
  r as (select doc_id, list_sort(list(i)) as removed from g group by doc_id),
  y as (select x.doc_id, x.text, x.ls, coalesce(r.removed, []) as removed from x left join r using (doc_id)),
  z as (select *, list_transform(list_filter(range(1, len(ls) + 1), lambda j: not list_contains(removed, j - 1)), lambda j: ls[j]) as kept from y)
  select doc_id, cast(coalesce(len(ls), 0) as bigint) as n_lines, cast(len(removed) as bigint) as n_removed, array_to_string(removed, ',') as removed, len(removed) > 0 and not coalesce(list_bool_or(list_transform(kept, lambda t: len({_WORDS.format("t")}) > 0)), false) as emptied, sha256(case when len(removed) = 0 then text else array_to_string(kept, chr(10)) end) as text_sha256 from z""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
