"""Registered queries of the training-data operators, with production
parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, kneser_ney, licences, nearest, prefix_trie, ranked_search, sharding, simhash, token_counts, toxicity, url_filter
from .licence_texts import KNOWN
from .common import read_table, scratch_path, scratch_scope, settled, text_or_empty, utf8_size

URL_RULES = (
    url_filter.Rule("org/", "allow"), url_filter.Rule("example.org/es/", "block"),
    url_filter.Rule("example.org/en/1", "block"), url_filter.Rule("com/fr/", "allow"),
    url_filter.Rule("com/de/", "block"),
)
OVER_LIMIT = 4096
SHARDS = 16


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return licences.scan(docs).select("doc_id", "digest", "licence_id",
                                      F.array_join("notices", ",").alias("notices"))


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    path = tokenizer_path("byte_bpe_50k.json")
    coded = bpe.encode(docs, path, keep=["doc_id"], decoded_col="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        bpe.ids_digest("ids").alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_nearest(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    return settled(spark, "op3", lambda: nearest.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20))


def op4_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels")
    return settled(spark, "op4", lambda: kneser_ney.classify(docs, labels).select(
        F.col("key").alias("doc_id"), "lang", "n_chars", "perplexity", "threshold", "rejected"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read_table(spark, sf, "labels"))
    return (toxicity.score(docs, model, keep=["doc_id"])
            .select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted"))


def op6_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    rows = decontaminate.find_overlaps(docs, read_table(spark, sf, "benchmark"), keep=["doc_id"])
    best = F.array_max(F.transform("hits", lambda h: F.struct(
        h["matched"].alias("matched"), (-h["item_id"]).alias("item"),
        (h["end_word"] - h["start_word"]).alias("words"))))
    return rows.select("doc_id", decontaminate.is_contaminated("hits").alias("contaminated"),
                       F.size(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("n_items"),
                       (-best["item"]).alias("item_id"), best["words"].alias("overlap_words"),
                       best["matched"].alias("matched_words"))


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return settled(spark, "op7", lambda: simhash.near_duplicates(docs, shingle=3, max_bits=3).select(
        "doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id"))


def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Block list: host and path of every page that some URL links to with a
    referral mark (``ref=`` in its query)."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    url = F.col("url").cast("string")
    listed = (pages.where(url.contains("://") & url.rlike(r"[?&]ref="))
              .select(F.concat(url_filter.host(url), url_filter.path(url)).alias("key")))
    return url_filter.judge(pages, URL_RULES, listed)


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return settled(spark, "op9", lambda: token_counts.token_counts(
        docs, tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "token-count-cache")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit")))


def op10_external_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    out = scratch_path(spark, "shards")
    with scratch_scope(spark):
        sharding.write_shards(sharding.external_shuffle(docs, SHARDS), out)
    shards = spark.read.parquet(out)
    return shards.select("doc_id", (utf8_size("text") + 1).alias("size"),
                         F.crc32(text_or_empty("text").cast("binary")).alias("text_crc32"),
                         F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return settled(spark, "op11", lambda: ranked_search.ranked_search(docs, read_table(spark, sf, "benchmark")))


OP11_SQL = r"""
WITH dt AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), qt AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), len AS (
  SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id
), total AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, total GROUP BY term, nn
), m AS (
  SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM len, total
), scored AS (
  SELECT q.item_id, t.doc_id, CAST(sum(q.times * w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m))) AS BIGINT) AS score
  FROM qt q JOIN tf t USING (term) JOIN w USING (term) JOIN m ON m.doc_id = t.doc_id GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return settled(spark, "op12", lambda: exact_dedup.exact_duplicates(docs))


OP12_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM n WINDOW same AS (PARTITION BY t)
"""


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return settled(spark, "op13", lambda: prefix_trie.conversation_trie(turns))


# CRC-32 of the decimal id, a bit at a time
OP13_SQL = """
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, n, c - c % 5 AS base, xor(list_reduce(list_concat([4294967295::BIGINT],
           list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM own GROUP BY c)
), rebuilt AS (
  SELECT v.c, v.h, 0 AS part, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.base AND o.pos < v.h
  UNION ALL
  SELECT v.c, v.h, 1, o.pos, o.role, o.text FROM convs v JOIN own o ON o.c = v.c AND o.pos >= v.h
), seqs AS (
  SELECT v.c, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.part, r.pos) FILTER (WHERE r.c IS NOT NULL), []) AS seq
  FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c
), prefixes AS (
  SELECT c, len(seq) AS n, d, seq[1:d] AS prefix FROM seqs, unnest(range(0, len(seq) + 1)) AS t(d)
), nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(prefix[d].text)) END AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, prefix
), children AS (
  SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.d = n.d AND k.prefix = n.prefix
), below AS (
  SELECT a AS d, f.prefix[1:a] AS prefix, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(f.saved) AS saved_tokens
  FROM full_nodes f, unnest(range(0, f.d + 1)) AS t(a) GROUP BY 1, 2
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.d = f.d AND b.prefix = f.prefix
LEFT JOIN nodes p ON p.d = f.d - 1 AND p.prefix = f.prefix[1:f.d - 1]
"""


def op1_sql() -> str:
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''"))
                       for i, (n, t) in enumerate(KNOWN))
    return f"""
WITH known AS (
  SELECT sha256(translate({licences.canonical_lines_sql("text")}, chr(10), ' ')) AS digest,
         arg_min(licence_id, place) AS licence_id
  FROM (VALUES {values}) AS t(place, licence_id, text) GROUP BY 1
), docs AS (
  SELECT doc_id, {licences.canonical_lines_sql("coalesce(text, '')")} AS lines FROM documents
)
SELECT d.doc_id, sha256(translate(d.lines, chr(10), ' ')) AS digest, k.licence_id,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(d.lines, chr(10)),
         lambda x: m.by_digest[sha256(x)]), lambda x: x IS NOT NULL))), ',') AS notices
FROM docs d LEFT JOIN known k ON k.digest = sha256(translate(d.lines, chr(10), ' '))
CROSS JOIN (SELECT map(list(digest), list(licence_id)) AS by_digest FROM known) m
"""


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule, rule_host, rule_path, rule_verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
         ('com/de/', 'com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.url, p.host, p.path, r.rule, r.rule_verdict
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
), best AS (
  SELECT page_id, url, max_by(rule, length(rule)) AS rule, max_by(rule_verdict, length(rule)) AS rule_verdict
  FROM fits GROUP BY page_id, url
), listed AS (
  SELECT DISTINCT host || path AS key FROM parts
  WHERE strpos(url, '://') > 0 AND regexp_matches(url, '[?&]ref=')
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.rule_verdict, CASE WHEN p.host <> '' AND l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p
LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.url IS NOT DISTINCT FROM b.url
LEFT JOIN listed l ON l.key = p.host || p.path
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licences": op1_licences,
        "op2_bpe": op2_bpe,
        "op3_nearest": op3_nearest,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_decontaminate": op6_decontaminate,
        "op7_simhash": op7_simhash,
        "op8_url_filter": op8_url_filter,
        "op9_token_counts": op9_token_counts,
        "op10_external_shuffle": op10_external_shuffle,
        "op11_ranked_search": op11_ranked_search,
        "op12_exact_dedup": op12_exact_dedup,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_licences": op1_sql(), "op8_url_filter": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_exact_dedup": OP12_SQL,
            "op13_prefix_trie": OP13_SQL}
