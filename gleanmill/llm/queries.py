"""The operators as named queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm import centroids, chat, licenses, lines, lm, media, mixing, neardup, packing, prefixes, quality, toxicity, warc
from gleanmill.llm.common import documents, held_out
from gleanmill.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    turns = documents(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string"
    )
    read = chat.read_chats(chat.format_chats(turns.unionByName(added)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# Lengths by counting: a backslash doubles, a '#' after a '#' and '</turn>' grow by one, and a
# header costs 6 characters and its role (with ':' and the same rules; roles here have none).
OP1_SQL = r"""
WITH added AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM added
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(text) + length(text) - length(replace(text, '\', ''))
      + (length(text) - length(replace(text, '#', ''))) - len(regexp_extract_all(text, '#+'))
      + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 7 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(role) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_totals(documents(spark, folder))


OP4_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY skey
), w AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM w
), t AS (
  SELECT skey, source_size, CASE WHEN rate * w >= cap THEN cap
    ELSE max(CASE WHEN rate * w < cap THEN rate END) OVER () * w END AS target FROM r
), c AS (
  SELECT *, least(64, greatest(1, source_size // 64)) AS b FROM t WHERE target > 0
), k AS (
  SELECT *, CAST(ceil(target / b) AS BIGINT) AS due, (source_size + b - 1) // b AS blocks FROM c
), p AS (
  SELECT skey, b, block, due // blocks + CASE WHEN block < due % blocks THEN 1 ELSE 0 END AS times
  FROM (SELECT *, unnest(range(blocks)) AS block FROM k)
), laid AS (
  SELECT *, row_number() OVER () AS row, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY h, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n
), taken AS (
  SELECT row, sum(times * (least(start + size, (block + 1) * b) - greatest(start, block * b))) AS taken
  FROM laid JOIN p ON laid.skey = p.skey AND size > 0 AND block >= start // b AND block <= (start + size - 1) // b
  GROUP BY row
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM laid JOIN t USING (skey) LEFT JOIN taken USING (row)
"""


def op5_quality_lines(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder)).select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT row, unnest(range(1, greatest(len(words) - 7, 0) + 1)) AS pos, words FROM d
), windows AS (
  SELECT row, pos, count(*) OVER (PARTITION BY row, array_to_string(words[pos:pos + 7], ' ')) AS times FROM grams
), covered AS (
  SELECT row, count(DISTINCT pos + k) AS n_repeat_words
  FROM windows, (SELECT unnest(range(0, 8)) AS k) WHERE times > 1 GROUP BY row
), lines AS (
  SELECT row, line, regexp_matches(line, '[^\x20\x09-\x0D]') AS has_words,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
), judged AS (
  SELECT *, has_words AND (
    NOT regexp_matches(line, '[.!?…。！？:;][\x22\x27)\]”»]*([\x20\x09-\x0D]|\z)')
    OR regexp_matches(line, '(?s) [|»›·] .* [|»›·] .* [|»›·] ')
    OR length(line) <= 200 AND regexp_matches(line, '(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|licensed under|lorem ipsum|enable javascript|click here|sign up for|subscribe to our|copyright (\(c\)|©))')
    OR 10 * len(regexp_extract_all(line, '[#*$%&|<>]')) > 3 * n
    OR 10 * ((length(line) - length(replace(line, '!!', ''))) // 2) > 3 * n) AS bad
  FROM lines
), by_doc AS (
  SELECT row, count(*) FILTER (WHERE has_words) - count(DISTINCT line) FILTER (WHERE has_words) AS n_dup_lines,
    sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (WHERE NOT bad), 0) AS good
  FROM judged GROUP BY row
), figures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CASE WHEN chars > 0 THEN 1 - good / chars ELSE 0 END <= 0.6 AS enough
  FROM d JOIN by_doc USING (row) LEFT JOIN covered USING (row)
)
SELECT * EXCLUDE (enough), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND enough AS kept
FROM figures
"""

def op3_warc_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = documents(spark, folder, "pages")
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path)
    return warc.resolved(warc.read_archives(spark, path)).drop("verified")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
), d AS (
  SELECT page_id, top, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INT), 5))::BIGINT // CAST(pow(32, 3 - i % 4) AS BIGINT)) % 32 + 1 AS INT), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""


def public_vocabulary() -> tuple[str, str]:
    """Ranks and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_specials() -> tuple[tuple[str, int], ...]:
    """Added tokens of the vocabulary's json form, which it finds in texts by default."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return tuple((token["content"], token["id"]) for token in json.load(file)["added_tokens"])


def op7_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    ranks, pattern = public_vocabulary()
    return packing.pack(documents(spark, folder), ranks, pattern, specials=public_specials()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxicity.fit(docs, documents(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda n: held_out(F.col("doc_id"), 7, n)
    return lm.lm_scores(documents(spark, folder), ~part(2), part(5)).withColumn("held_out", part(2))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_fates(documents(spark, folder))


OP8_SQL = r"""
WITH RECURSIVE l AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM (
    SELECT doc_id, i - 1 AS line_no, line FROM (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
      FROM documents) WHERE regexp_matches(line, '[^\x20\x09-\x0D]'))
), c AS (
  SELECT line, min(place) AS id FROM l GROUP BY line
), g AS (
  SELECT DISTINCT id, substr(line, i, 9) AS s FROM (SELECT id, line, unnest(range(1, length(line) - 7)) AS i FROM c)
), n AS (
  SELECT id, count(*) AS n FROM g GROUP BY id
), links AS (
  SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.s = b.s AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id
  GROUP BY a.id, b.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reached AS (
  SELECT id AS node, id AS seen FROM c UNION SELECT node, b FROM reached JOIN links ON seen = a
), f AS (
  SELECT node, min(seen) AS first FROM reached GROUP BY node
)
SELECT l.doc_id, CAST(l.line_no AS INT) AS line_no, o.doc_id AS first_doc, CAST(o.line_no AS INT) AS first_line, l.place = first AS kept
FROM l JOIN c USING (line) JOIN f ON node = c.id JOIN l o ON o.place = first
"""


def op9_media_chunks(spark: SparkSession, folder: str) -> DataFrame:
    catalogue, store = media.store_media(documents(spark, folder))
    return catalogue.join(media.read_media(store), "media").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM l JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM d
  UNION SELECT node, b FROM reached JOIN links ON seen = a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM reached GROUP BY node) USING (doc_id)
"""


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefixes.numbered_turns(documents(spark, folder, "conversations"))
    return prefixes.prefix_trie(prefixes.spliced_turns(turns))


# crc32 of the decimal id, by the reflected polynomial, bit by bit
OP11_SQL = r"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, s, 1 AS i, 4294967295 AS v FROM ids
  UNION ALL
  SELECT c, s, i + 1, list_reduce([xor(v, CAST(ord(s[i]) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)
  FROM crc WHERE i <= length(s)
), h AS (
  SELECT c, c - c % 5 AS b, xor(v, 4294967295) % 9 AS h FROM crc WHERE i = length(s) + 1
), t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT h.c, k, role, text FROM h JOIN t ON t.c = h.b WHERE k <= h
  UNION ALL SELECT h.c, k, role, text FROM h JOIN t ON t.c = h.c WHERE k > h
), q AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY k) AS d, strlen(text) AS w,
    list({'role': role, 'text': text}) OVER (PARTITION BY c ORDER BY k) AS path FROM r
  UNION ALL SELECT c, 0, 0, [] FROM h
), top AS (
  SELECT c, max(d) AS n FROM q GROUP BY c
), nodes AS MATERIALIZED (
  SELECT row_number() OVER () AS node, path, d, min(c) AS id, count(*) AS n, any_value(w) AS w,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM q JOIN top USING (c) GROUP BY path, d
), line AS (
  SELECT a.node AS node, b.node AS below, b.n AS n, b.w AS w, b.d = a.d + 1 AS child
  FROM nodes a JOIN nodes b ON b.d >= a.d AND b.path[1:a.d] = a.path
), family AS (
  SELECT node, count(*) FILTER (WHERE child) AS n_children, sum((n - 1) * w) AS saved FROM line GROUP BY node
), leaves AS (
  SELECT line.node AS node, count(*) AS n_leaves FROM line JOIN family f ON f.node = line.below WHERE f.n_children = 0 GROUP BY 1
)
SELECT a.id AS conv_id, a.d AS depth, p.id AS parent_conv_id, a.n AS n_convs, n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN family USING (node) JOIN leaves USING (node) LEFT JOIN nodes p ON p.d = a.d - 1 AND p.path = a.path[1:a.d - 1]
"""


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(documents(spark, folder)).drop("spans")


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(documents(spark, folder, "embeddings"))


def clustering_sql(size: int, clusters: int, rounds: int, seed: int) -> str:
    """Lloyd rounds by measuring every vector against every centroid, one set of expressions per round."""
    steps = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {size}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INT) AS k, e AS c
  FROM v QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {clusters}
)"""]
    for n in range(rounds + 1):
        steps.append(f""", a{n} AS MATERIALIZED (
  SELECT row, any_value(vec_id) AS vec_id, any_value(e) AS e,
    min({{'d': CAST(list_sum(list_transform(list_zip(e, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': k}}) AS near
  FROM v, c{n} GROUP BY row
)""")
        if n < rounds:
            steps.append(f""", m{n} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT near.k AS k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY k, i
), c{n + 1} AS MATERIALIZED (
  SELECT k, coalesce(moved, c) AS c FROM c{n} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS moved FROM m{n} GROUP BY k) USING (k)
)""")
    return "".join(steps) + f"""
SELECT vec_id, near.k AS cluster, near.d AS distance, CAST(sum(near.d) OVER (PARTITION BY near.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(near.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON k = near.k
"""


OP13_SQL = clustering_sql(centroids.SIZE, centroids.CLUSTERS, centroids.ROUNDS, 2)

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_toxicity, op3_warc_pages, op4_mix_sources, op5_quality_lines, op6_lm_score,
        op7_pack_sequences, op8_line_dedup, op9_media_chunks, op10_near_duplicates,
        op11_prefix_trie, op12_license_scan, op13_centroid_clusters,
    )
}
SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL, "op3_warc_pages": OP3_SQL, "op4_mix_sources": OP4_SQL, "op5_quality_lines": OP5_SQL,
    "op8_line_dedup": OP8_SQL, "op10_near_duplicates": OP10_SQL,
    "op11_prefix_trie": OP11_SQL, "op13_centroid_clusters": OP13_SQL,
}
