"""The registered queries of this subpackage: name → (Spark callable, SQL text or None)."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from rentloom.llm import bpe, chunks, filter_audit, hard_negatives, kdtree, kmeans_tree, minhash, packing, pages, quality, suffixes, toxicity, url_filter
from rentloom.llm.common import documents

ENTRIES: dict = {}


def entry(name: str, sql: str | None = None):
    def add(fn):
        ENTRIES[name] = (fn, sql)
        return fn

    return add


@entry("op2_nnls_packing")
def op2(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@entry("op10_byte_bpe")
def op10(spark, sf_dir):
    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@entry("op8_toxicity_cnn")
def op8(spark, sf_dir):
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@entry("op9_subword_quality")
def op9(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@entry(
    "op3_circulant_minhash",
    """
    with recursive words as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
        from documents
    ),
    sets as (
        select doc_id, case when len(w) < 2 then list_filter([array_to_string(w, ' ')], lambda x: x <> '')
                            else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
        from words
    ),
    shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
    links as (
        select a.doc_id as x, b.doc_id as y
        from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        group by a.doc_id, b.doc_id, a.n, b.n
        having 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ),
    reach(doc_id, other) as (
        select doc_id, doc_id from sets
        union
        select r.doc_id, case when l.x = r.other then l.y else l.x end from reach r join links l on l.x = r.other or l.y = r.other
    ),
    least_of as (select doc_id, min(other) as component_id from reach group by doc_id)
    select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
    from sets s join least_of c on c.doc_id = s.doc_id
    """,
)
def op3(spark, sf_dir):
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


@entry("op4_gear_chunks")
def op4(spark, sf_dir):
    return chunks.remove_repeats(documents(spark, sf_dir), "spans", whole=True).select("doc_id", "text", "spans")


@entry("op5_deep_shallow_suffixes")
def op5(spark, sf_dir):
    removed = suffixes.remove_repeats(documents(spark, sf_dir))
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@entry("op6_kmeans_tree")
def op6(spark, sf_dir):
    return kmeans_tree.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@entry(
    "op7_kd_trees",
    """
    with whole as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where vec_id is not null and embedding is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    scored as (
        select q.vec_id as query_id, c.vec_id,
               cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
        from whole q join whole c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)
    )
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
    from scored
    qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
)
def op7(spark, sf_dir):
    return kdtree.top_k(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


@entry("op1_page_differencing")
def op1(spark, sf_dir):
    return pages.extract(documents(spark, sf_dir, "pages"))


@entry(
    "op11_slot_negatives",
    """
    with whole as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
               list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
        from embeddings
        where vec_id is not null and label is not null and embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    ),
    scored as (
        select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
               cast(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) as bigint) as score
        from whole a join whole c on a.vec_id % 100 = 0 and c.vec_id <> a.vec_id and len(a.v) = len(c.v)
    ),
    positives as (
        select anchor_id, vec_id as positive_id, score as positive_score from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
    )
    select p.anchor_id, p.positive_id,
           cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
           n.vec_id as negative_id, p.positive_score, n.score as negative_score
    from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
     and 30 * p.positive_score <= 100 * n.score and 100 * n.score <= 90 * p.positive_score
    qualify row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) <= 10
    """,
)
def op11(spark, sf_dir):
    rows = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, k=10, low=30, high=90, scale=256)


URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@entry(
    "op12_blocked_bloom",
    """
    with rules(rule_host, rule_path, verdict) as (
        values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
               ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ),
    parts as (
        select page_id, row_number() over () as r,
               translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
        from pages
    )
    select p.page_id, p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
           coalesce(arg_max(verdict, length(rule_host || rule_path)), 'allow') as verdict
    from parts p left join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path)
    group by p.page_id, p.r, p.host, p.path
    """,
)
def op12(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(documents(spark, sf_dir, "pages"), rules, otherwise="allow")


@entry(
    "op13_filter_audit",
    """
    with known as (
        select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic
        from labels group by doc_id
    ),
    texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
    least as (select t, min(doc_id) as least from texts group by t),
    words as (
        select x.doc_id, part, t, least, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w
        from texts x join least using (t)
    ),
    failing as (
        select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
               case when len(w) < 50 then 'A' else '' end
               || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
               || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end
               || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
               || case when words.doc_id > least then 'E' else '' end as fl
        from words left join known on known.doc_id = words.doc_id
    ),
    counted as (select part, good, toxic, fl, count(*) as n from failing group by all),
    letter(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
    steps as (
        select a.x || b.x || c.x || d.x || e.x as filter_order, unnest(range(1, 6)) as step
        from letter a join letter b on b.x <> a.x join letter c on c.x not in (a.x, b.x) join letter d on d.x not in (a.x, b.x, c.x)
        join letter e on e.x not in (a.x, b.x, c.x, d.x)
    ),
    judged as (
        select part, filter_order, step, good, toxic, n, substr(filter_order, step, 1) as f, length(fl) as many,
               contains(fl, substr(filter_order, step, 1)) as fails,
               length(translate(substr(filter_order, 1, step - 1), fl, '')) < step - 1 as earlier
        from counted, steps
    ),
    summed as (
        select part, filter_order, step, f,
               sum(case when not fails and not earlier then n else 0 end) as kept,
               sum(case when fails and not earlier then n else 0 end) as removed,
               sum(case when fails and earlier then n else 0 end) as redundant,
               sum(case when fails and many = 1 then n else 0 end) as unique_fails,
               sum(case when fails and not earlier and good then n else 0 end) as good_lost,
               sum(case when fails and not earlier and toxic then n else 0 end) as toxic_lost
        from judged group by part, filter_order, step, f
    )
    select part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
           cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
           cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
           cast(sum(removed) over (partition by part, f) as bigint) as shapley
    from summed
    """,
)
def op13(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), part="source")


ENTRIES["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
