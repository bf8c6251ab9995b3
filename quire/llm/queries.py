"""Queries of the training-data operators: each applies one with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroid_clustering import cluster_vectors
from .chat_format import expand, format_conversations, read_back
from .common import load
from .embedding_dedup import near_duplicates
from .jaccard_join import jaccard_join
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .packing import best_fit_packing
from .pii import digest, find_pii
from .quality_classifier import classify_quality, trusted_ids
from .quality_rules import apply_rules
from .sentencepiece_scan import decode, encode
from .source_divergence import divergence
from .token_counts import count_tokens


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(load(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(load(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(load(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select -1L conv_id, turn, role, '</s>[INST] ok [/INST]' text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return read_back(expand(format_conversations(turns.unionByName(own))))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(load(spark, sf_dir, "documents"), trusted_ids(load(spark, sf_dir, "labels")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(load(spark, sf_dir, "documents")))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_pii": op12_pii,
    "op13_centroid_clustering": op13_centroid_clustering,
}

def _centroids_sql(k: int = 8, rounds: int = 10) -> str:
    """Lloyd's rounds written out: c0, a0, c1, ... are centroids and assignments."""
    far = "list_sum(list_transform(generate_series(1, 64), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))"
    steps = [f"""v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) q from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x::double))) = 64)""",
        f"c0 as materialized (select row_number() over (order by h, q) - 1 c, q from (select sha256('3:' || vec_id) h, q from v order by h, q limit {k}))"]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select r, arg_min(c, (d, c)) c, min(d) d from (select v.r, c.c, {far}::bigint d from v cross join c{i} c) group by r)")
        if i < rounds:
            means = f"select c, list(m order by i) q from (select c, i, floor_div(sum(x), count(*)) m from (select a.c, unnest(v.q) x, generate_subscripts(v.q, 1) i from v join a{i} a using (r)) group by c, i) group by c"
            steps.append(f"c{i + 1} as materialized (select c{i}.c, coalesce(n.q, c{i}.q) q from c{i} left join ({means}) n using (c))")
    return f"""with {', '.join(steps)}
select vec_id, a.c::int as cluster, d as distance, (sum(d) over (partition by a.c))::bigint cluster_inertia, (sum(d) over ())::bigint inertia, sha256(array_to_string(z.q, ',')) centroid_sha256
from v join a{rounds} a using (r) join c{rounds} z on z.c = a.c""".replace("floor_div(sum(x), count(*))", "((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::bigint")


_SHARE = "(1 + (1000000000 * ({0} + 1)::hugeint) // ({1}))"
ORACLE: dict[str, str] = {
    "op11_source_divergence": f"""
with d as (select row_number() over () r, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source from documents),
t as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term from d),
kept as (select lang, term, count(*) n from t group by all having count(distinct r) >= 3),
groups as (select distinct lang, source from d),
used as (select lang, source, term, count(*) n from t join kept using (lang, term) group by all),
cells as (select g.lang, g.source, k.term, k.n lang_n, coalesce(u.n, 0) n, sum(coalesce(u.n, 0)) over (partition by g.lang, g.source) + count(*) over (partition by g.lang, g.source) m from groups g join kept k using (lang) left join used u using (lang, source, term)),
langs as (select lang, sum(n) + count(*) m from kept group by lang),
p as (select c.lang, source, term, n, {_SHARE.format("n", "c.m")} p, {_SHARE.format("lang_n", "l.m")} q from cells c join langs l using (lang)),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, 'term' part, term item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 200
""",
    "op13_centroid_clustering": _centroids_sql(),
    "op8_chat_formatting": """
with turns as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
               union all select -1, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) t(turn, role)),
sized as (select *, length(role) + length(text) + length(regexp_replace(role || text, '[^\\\\<\\[|]', '', 'g')) + 8 chars,
                 row_number() over (partition by conv_id order by turn, role, text) pos from turns),
ended as (select *, sum(chars) over (partition by conv_id order by pos) ends, max(pos) over (partition by conv_id) last,
                 max(case when role = 'assistant' then pos end) over (partition by conv_id) hit from sized)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) loss_sha256,
       (sum(case when role = 'assistant' then ends else 0 end) + max(case when pos = last and coalesce(hit, 0) < last then ends else 0 end))::bigint formatted_chars
from ended group by conv_id
""",
    "op6_line_dedup": """
with texts as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
lines as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from texts),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from lines),
held as (select k, min(doc_id) first, count(distinct doc_id) n from keyed where length(k) >= 10 group by k),
marked as (select doc_id, line, i, coalesce(n >= 2 and doc_id <> first, false) lost from keyed left join held using (k))
select doc_id, count(*)::bigint n_lines, (count(*) filter (lost))::bigint n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (not lost), '')) kept_sha256
from marked group by doc_id
""",
}
