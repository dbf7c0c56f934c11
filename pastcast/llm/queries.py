"""The thin ``opN_<name>`` queries over whole tables, and their DuckDB SQL where there is one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_sharding")
def op5(spark, sf_dir):
    """Law ``rows``: shard sizes are at most one row apart."""
    from .sharding import assign_shards
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(slim, shards=8, seed=5).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op3_url_filter", r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, CASE
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ends_with('.' || host, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN contains(host, 'casino') OR contains(host, 'poker') OR contains(host, 'free-bets') OR contains(host, 'cheap-pills')
      OR contains(host, 'viagra') OR contains(host, 'ads-track') OR contains(host, 'doubleclick') OR contains(host, 'adserver')
      OR contains(host, 'xxx') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled""")
def op3(spark, sf_dir):
    from .url_filter import DOMAIN_RULES, GLOB_RULES, filter_urls
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, [*DOMAIN_RULES, *GLOB_RULES]).select(
        "page_id", "host", "path", F.when(F.col("rule_kind") == "domain", F.col("rule")).alias("rule"), "verdict")


@query("op8_mixing")
def op8(spark, sf_dir):
    from .mixing import mix, source_key, word_count
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"))
    documents, sources, used = mix(sized)
    row = ["doc_id", "source_key", "size", "copy"]
    taken = used.groupBy(*row).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"), F.min("first_place").alias("first_place"))
    known = documents.select(*row).withColumn("taken", F.lit(0).cast("long")).unionByName(taken, allowMissingColumns=True)
    return (known.groupBy(*row).agg(F.sum("taken").alias("taken"), F.min("first_place").alias("first_place"))
            .join(sources.select("source_key", "source_size", "target"), "source_key")
            .select("doc_id", "size", "source_size", "target", "taken", F.col("first_place.shard").alias("first_shard"),
                    F.col("first_place.slot").alias("first_slot")))


@query("op9_simhash")
def op9(spark, sf_dir):
    from .simhash import near_duplicates
    linked = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_token_counts")
def op1(spark, sf_dir):
    """Tokens of every line of every document, boundary tokens to the line with most of their bytes."""
    from .token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), rule="largest")


@query("op10_token_output")
def op10(spark, sf_dir):
    from .common import shared_path
    from .token_store import read_store, write_store
    path = shared_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, end_id=2)
    return read_store(spark, path, with_ids=False)


@query("op7_winnowing")
def op7(spark, sf_dir):
    from .winnowing import as_string, fingerprint, hashes, likeness, with_neighbours
    n = F.length("text")
    rows = with_neighbours(table(spark, sf_dir, "documents")).withColumns({
        "n_chars": n.cast("long"),
        "edited": F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("addition"))})
    kept = rows.withColumns({"kept": fingerprint(F.col("text")), "edited_kept": fingerprint(F.col("edited"))}).withColumns(
        {"own": hashes(F.col("kept")), "other": hashes(F.col("edited_kept"))})
    return kept.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("kept")).alias("fingerprint"), as_string(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"))


@query("op4_toxicity")
def op4(spark, sf_dir):
    from .toxicity import learn, learnable, score_texts
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = learn(documents, table(spark, sf_dir, "labels"))
    return score_texts(documents, grammar).select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted")


@query("op2_decontamination")
def op2(spark, sf_dir):
    from .decontamination import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_substring_dedup")
def op6(spark, sf_dir):
    from .substring_dedup import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op11_hnsw")
def op11(spark, sf_dir):
    from .hnsw import nearest
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


@query("op12_prefix_trie", r"""
WITH placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
                       md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tid,
                       len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
                FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, n, xor(list_reduce(list_concat([4294967295::BIGINT],
                 list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
                 lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)::BIGINT[]),
                 lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1)))), 4294967295::BIGINT) % 4 AS h
          FROM (SELECT conv_id, count(*) AS n FROM placed GROUP BY conv_id)),
lent AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) AS lent FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
turns AS (SELECT l.conv_id, p.pos, p.tid, p.words FROM lent l JOIN placed p ON p.conv_id = l.base AND p.pos <= l.lent
          UNION ALL SELECT l.conv_id, p.pos - l.h + l.lent, p.tid, p.words FROM lent l JOIN placed p ON p.conv_id = l.conv_id AND p.pos > l.h),
paths AS (SELECT conv_id, pos AS depth, string_agg(tid, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, words FROM turns
          UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS n FROM paths GROUP BY conv_id),
nodes AS (SELECT p.path, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.words) AS words, max(l.n) = p.depth AS leaf,
                 sha256(coalesce(string_agg(CASE WHEN l.n = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
          FROM paths p JOIN lengths l USING (conv_id) GROUP BY p.path, p.depth),
below AS (SELECT a.path, sum(CASE WHEN d.leaf THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens
          FROM nodes a JOIN nodes d ON starts_with(d.path, a.path) GROUP BY a.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND starts_with(c.path, n.path)) AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND starts_with(n.path, p.path)""")
def op12(spark, sf_dir):
    from .prefix_trie import prefix_trie, rebuilt, turns_in_order
    turns = turns_in_order(table(spark, sf_dir, "conversations"))
    return prefix_trie(*rebuilt(turns)).drop("n_ends")


@query("op13_repair")
def op13(spark, sf_dir):
    from .repair import damaged, repair_report
    conversations = table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))
