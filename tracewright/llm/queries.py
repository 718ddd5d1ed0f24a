"""The registered queries of this subpackage, each the whole intended table through its operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (
    bestfit, decontaminate, divergence, infill, language, packing, pieces, ppm, secrets, simhash, topk, toxicity, wrapper,
)
from tracewright.llm.common import id_hash, table

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_PIECES = "/opt/tokenizers/byte_bpe_50k.json"


def fold(k: int, of: int):
    """Rows of the held-out part, by their id."""
    return F.coalesce(id_hash(F.col("doc_id")) % of == k, F.lit(False))


def op1_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 50 == 0)


OP1_SQL = """
with v as (
  select row_number() over () as r, vec_id, [floor(256 * x::double) for x in embedding] as e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.r, q.vec_id as query_id, d.vec_id, cast(list_inner_product(q.e, d.e) as bigint) as score
  from v q join v d on q.r <> d.r where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("__key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(0, 5)
    model = toxicity.learn(docs, labels, ~held_out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.empty_ledger(spark))
    base = {r.kind for r in secrets.RULES}

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("findings", lambda f: f["kind"].isin(*sorted(base)))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(of_base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), "blob",
    )


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(0, 10)
    scored = ppm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(0, 5)
    found = language.classify(docs, language.learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op8_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"), width=4, radius=4)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.read_model(PIECES))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents
), w as (
  select r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d
), c as (select lang, source, term, count(*) as n from w group by all
), k as (select lang, term from (select distinct r, lang, term from w) group by all having count(*) >= 30
), g as (select distinct lang, source from d
), v as (select lang, count(*) as v from k group by all
), gt as (select c.lang, c.source, sum(n) as n from c join k using (lang, term) group by all
), lt as (select c.lang, sum(n) as n from c join k using (lang, term) group by all
), q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c.n) + 5)) // (max(lt.n) + 5 * max(v.v)) as q
  from c join k using (lang, term) join lt using (lang) join v using (lang) group by all
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(gt.n, 0) + 5 * v.v) as p
  from g join k using (lang) join v using (lang) left join c using (lang, source, term) left join gt using (lang, source)
), s as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q
), r as (
  select lang, source, part, item, cast(value as bigint) as value,
    cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
  from (select * from pairs union all select * from terms)
)
select * from r where part = 'pair' or rank <= 50
"""


def op12_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bestfit.tokens(table(spark, sf_dir, "documents"), BYTE_PIECES, keep_ids=False)
    return bestfit.pieces(bestfit.pack(rows)).drop("row")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


OP13_SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as h from documents
), u as (
  select *, ('0x' || substr(h, 1, 8))::bigint % (n + 1) as one, ('0x' || substr(h, 9, 8))::bigint % (n + 1) as two,
    ('0x' || substr(h, 17, 8))::bigint % 100 as three, ('0x' || substr(h, 25, 8))::bigint % 100 as four
  from t
), f as (
  select *, least(one, two) as low, greatest(one, two) as high,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or three >= 90 then 'plain'
      when four < 20 then 'spm' else 'psm' end as form
  from u
), o as (
  select *, substr(text, 1, low) as prefix, substr(text, low + 1, high - low) as middle, substr(text, high + 1) as suffix from f
)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars,
  case when form <> 'plain' then high - low end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from o
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_voronoi": op1_voronoi,
    "op2_packing": op2_packing,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_secrets": op5_secrets,
    "op6_ppm": op6_ppm,
    "op7_language": op7_language,
    "op8_wrapper": op8_wrapper,
    "op9_simhash": op9_simhash,
    "op10_pieces": op10_pieces,
    "op11_divergence": op11_divergence,
    "op12_bestfit": op12_bestfit,
    "op13_infill": op13_infill,
}
ORACLES: dict[str, str] = {"op1_voronoi": OP1_SQL, "op11_divergence": OP11_SQL, "op13_infill": OP13_SQL}
