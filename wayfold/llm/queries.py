"""Registered queries of the text, page and vector operators, with their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import codebooks, curves, html_text, language, mixing, negatives, notices, packing, pii, simhash, spotsigs, token_counts, warc

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    """Register ``fn(table)`` under ``name``."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_counts", "documents")
def op1(docs):
    return token_counts.count_tokens(docs, tokenizer())


@query("op2_source_mix", "documents")
def op2(docs):
    return mixing.mix(docs)


@query("op3_personal_data", "documents")
def op3(docs):
    return pii.find(docs)


@query("op4_main_text", "pages")
def op4(pages):
    return html_text.extract(pages)


OP5 = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as n, sha1(html) as digest from p),
r as (select digest, max(page_id) as response from d where n >= 1000 group by digest)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.digest as payload_digest,
       case when d.page_id <> r.response then 'revisit' else 'response' end as record_type,
       case when d.page_id <> r.response then r.response end as refers_to
from d left join r on d.n >= 1000 and d.digest = r.digest"""


@query("op5_warc", "pages", OP5)
def op5(pages):
    return warc.archived(pages)


@query("op6_language", "documents")
def op6(docs):
    return language.identify_held_out(docs)


@query("op7_simhash", "documents")
def op7(docs):
    return simhash.near_duplicates(docs)


@query("op8_packing", "documents")
def op8(docs):
    return packing.pack(docs, tokenizer())


@query("op9_spotsigs", "documents")
def op9(docs):
    return spotsigs.compare_with_next(docs)


@query("op10_curves", "embeddings")
def op10(rows):
    return curves.search(rows)


WHOLE = "[cast(floor(256 * cast(x as double)) as bigint) for x in embedding]"
USABLE = "embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0"


def nearest_entries(books: str) -> str:
    return f"""select part, vec_id, any_value(x) as x, min(struct_pack(d := d, e := e)) as m
        from (select p.part, p.vec_id, p.x, c.e, cast(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, c.x)]) as bigint) as d
              from p join {books} c on p.part = c.part) group by part, vec_id"""


def means(assigned: str, books: str) -> str:
    return f"""select c.part, c.e, coalesce(m.x, c.x) as x from {books} c left join (
          select part, e, list(cast(floor(total / n) as bigint) order by pos) as x
          from (select part, m.e as e, pos, sum(x[pos]) as total, count(*) as n
                from {assigned}, (select unnest(range(1, 1 + (select max(len(x)) from p))) as pos) group by 1, 2, 3)
          group by part, e) m on c.part = m.part and c.e = m.e"""


OP11 = f"""
with v as (select vec_id, label, {WHOLE} as q from embeddings where {USABLE}),
p as (select vec_id, part, list_slice(q, part * len(q) // 16 + 1, (part + 1) * len(q) // 16) as x from v, (select unnest(range(16)) as part)),
c0 as (select part, row_number() over (partition by part order by vec_id) - 1 as e, x from p where vec_id in (select vec_id from v order by vec_id limit 64)),
a0 as ({nearest_entries("c0")}), c1 as ({means("a0", "c0")}),
a1 as ({nearest_entries("c1")}), c2 as ({means("a1", "c1")}),
a2 as ({nearest_entries("c2")}),
d as (select vec_id, string_agg(format('{{:02x}}', m.e), '' order by part) as code, cast(sum(m.d) as bigint) as error from a2 group by vec_id),
t as (select label, cast(sum(error) as bigint) as label_error from d join v using (vec_id) group by label),
h as (select sha256(array_to_string(flatten(list(x order by part, e)), ',')) as codebooks_sha256 from c2)
select d.vec_id, d.code, d.error, t.label_error, h.codebooks_sha256
from d join v using (vec_id) join t on v.label is not distinct from t.label, h"""


@query("op11_codebooks", "embeddings", OP11)
def op11(rows):
    return codebooks.compress(rows)


@query("op12_notices", "documents")
def op12(docs):
    return notices.summary(docs)


OP13 = f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, {WHOLE} as q
           from embeddings where label is not null and {USABLE}),
s as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
             cast(list_sum([z[1] * z[2] for z in list_zip(a.q, b.q)]) as bigint) as score
      from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.*, s.other_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as r
      from p join s on s.anchor_id = p.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score)
select anchor_id, positive_id, cast(r as integer) as rank, negative_id, positive_score, negative_score from n where r <= 5"""


@query("op13_hard_negatives", "embeddings", OP13)
def op13(rows):
    return negatives.hard_negatives(rows)
