"""The registered training-data queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann_forest import nearest
from .chat_format import digests, format_conversations
from .collocations import collocations
from .common import at_most, materialize, read, shared_dir, word_count
from .kd_centroids import cluster
from .langid import fit as fit_languages, identify
from .license_scan import scan as scan_licenses
from .mixing import BROADCAST_ROWS, NULL, memberships, mix, source_targets
from .near_dedup import near_classes
from .packing import pack
from .quality import with_verdicts
from .token_store import read_store, store_path, write_store
from .warc import archive_path, read_archive, write_archive
from .toxicity import fit as fit_grammar, score as score_toxicity, training_sample


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return digests(format_conversations(turns.unionByName(extra)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(read(spark, sf_dir, "documents")).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = memberships(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "_members", "_times", word_count("text").alias("size"))
    docs = materialize(docs, "sizes")
    known = materialize(source_targets(docs, size=F.col("size")), "targets")
    mixed = mix(docs, F.col("_members"), known.select("source", F.col("target").alias("quota")), own=F.col("source"), size=F.col("size"), once=F.col("size") / F.col("_times"))
    known = at_most(known.select(F.coalesce("source", F.lit(NULL)).alias("_key"), F.col("size").alias("source_size"), "target"), BROADCAST_ROWS)
    out = mixed.withColumn("_key", F.coalesce("source", F.lit(NULL))).join(known, "_key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("_copies") * F.col("size")).cast("long").alias("taken"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).select("doc_id", "position", "family", F.round("probability", 6).alias("probability"), "shared")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    grammar = fit_grammar(training_sample(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_toxicity(docs, grammar).select("doc_id", held.alias("held_out"), "score", "predicted")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = archive_path(shared_dir(spark))
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit_languages(docs.where(part != 2).select("text", "lang"))
    return identify(docs, model).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the tokens bind here: the table tells no prompts from answers, and sequences are to have little padding."""
    return pack(read(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store_path(shared_dir(spark))
    write_store(read(spark, sf_dir, "documents"), path)
    return read_store(spark, path)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def chat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, each turn but the answers as its prompt, under limits on tokens, segments and loss-bearing tokens."""
    turns = read(spark, sf_dir, "conversations")
    said = lambda c: F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("turn", "text")))), lambda x: F.coalesce(x["text"], F.lit(""))))
    answer = F.col("role").eqNullSafe("assistant")
    rows = turns.groupBy("conv_id").agg(said(~answer).alias("prompt"), said(answer).alias("answer"))
    return pack(rows, doc_id="conv_id", text="answer", prompt="prompt", segments=3, loss=1536).withColumnRenamed("doc_id", "conv_id")


LLM_QUERIES = {
    "op1_chat": op1_chat,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_licenses": op4_licenses,
    "op5_toxicity": op5_toxicity,
    "op6_near_dedup": op6_near_dedup,
    "op7_warc": op7_warc,
    "op8_nearest": op8_nearest,
    "op9_language": op9_language,
    "op10_pack": op10_pack,
    "op11_phrases": op11_phrases,
    "op12_token_store": op12_token_store,
    "op13_centroids": op13_centroids,
    "chat_packing": chat_packing,
}

_WORD = r"'[^\x20\x09-\x0D]+'"

_QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '<null>') AS host FROM documents),
w AS (SELECT rid, doc_id, host, t, regexp_extract_all(t, {_WORD}) AS w FROM d),
pos AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT rid, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win WHERE c IS NOT NULL),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, host, t, line FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
norm AS (SELECT rid, host, t, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, {_WORD})) AS n FROM l),
texts AS (SELECT host, count(DISTINCT t) AS texts FROM d GROUP BY host),
over AS (SELECT host, line FROM norm JOIN texts USING (host) GROUP BY host, line, texts HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > texts * 0.1e0),
gone AS (SELECT rid, sum(n) AS n FROM norm JOIN over USING (host, line) GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed FROM w LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - removed) >= 30 * n_words AS kept, removed::BIGINT AS removed_words FROM f
"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) + CASE WHEN before IS NOT DISTINCT FROM role THEN 7 ELSE 20 + length(regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g')) END AS n FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, (3 + sum(n))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT html, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN m ON p.html = m.html
"""

_PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
x AS (SELECT pid, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT lang, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d FROM x WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (SELECT lang, [a] AS key, count(*) AS f FROM g GROUP BY ALL HAVING f >= 30
  UNION ALL SELECT lang, [a, b], count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY lang, a, b HAVING f >= 30
  UNION ALL SELECT lang, [a, b, c], count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY lang, a, b, c HAVING f >= 30
  UNION ALL SELECT lang, [a, b, c, d], count(*) AS f FROM g WHERE d IS NOT NULL GROUP BY lang, a, b, c, d HAVING f >= 30),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
cut AS (SELECT lang, key, f AS a, unnest(range(1, len(key))) AS k FROM f WHERE len(key) > 1),
s AS (SELECT c.lang, c.key, c.a, c.k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score
  FROM cut c JOIN f l ON l.lang = c.lang AND l.key = c.key[1:c.k] JOIN f r ON r.lang = c.lang AND r.key = c.key[c.k + 1:]),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, key ORDER BY score, k) = 1),
cover AS (SELECT lang, sub, max(f) AS f FROM (SELECT lang, f, key[i:i + m - 1] AS sub FROM (SELECT lang, f, key, m, unnest(range(1, len(key) - m + 2)) AS i FROM (SELECT lang, f, key, unnest(range(2, len(key))) AS m FROM f WHERE len(key) > 2))) GROUP BY ALL),
kept AS (SELECT b.*, array_to_string(b.key, ' ') AS phrase FROM best b LEFT JOIN cover c ON c.lang = b.lang AND c.sub = b.key WHERE c.f IS NULL OR 100::HUGEINT * c.f < 80::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def _centroids(rounds: int = 10) -> str:
    """The rounds written out: a<k> assigns to the centroids k<k>, from which k<k + 1> follows."""
    far = "list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2])::HUGEINT * (p[1] - p[2])))"
    assign = "a{0} AS MATERIALIZED (SELECT rid, min(struct_pack(d := d, c := c)) AS m FROM (SELECT rid, c, " + far + " AS d FROM v, k{0} k) GROUP BY rid)"
    move = """s{0} AS (SELECT c, i, floor_div FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT m.c AS c, i, sum(e) AS s, count(*) AS n FROM (SELECT m, unnest(x) AS e, generate_subscripts(x, 1) AS i FROM a{0} JOIN v USING (rid)) GROUP BY ALL))),
k{1} AS MATERIALIZED (SELECT k.c, coalesce(n.x, k.x) AS x FROM k{0} k LEFT JOIN (SELECT c, list(floor_div::BIGINT ORDER BY i) AS x FROM s{0} GROUP BY c) n USING (c))"""
    steps = [x for k in range(rounds) for x in (assign.format(k), move.format(k, k + 1))] + [assign.format(rounds)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e::DOUBLE))) = 64),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 8)),
{",\n".join(steps)},
i AS (SELECT m.c AS c, sum(m.d) AS own, sum(sum(m.d)) OVER () AS every FROM a{rounds} GROUP BY m.c)
SELECT vec_id, m.c::INTEGER AS cluster, m.d::BIGINT AS distance, own::BIGINT AS cluster_inertia, every::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN i ON i.c = m.c JOIN k{rounds} k ON k.c = m.c
"""


LLM_SQL = {"op1_chat": _CHAT, "op7_warc": _WARC, "op2_quality": _QUALITY, "op11_phrases": _PHRASES, "op13_centroids": _centroids()}
