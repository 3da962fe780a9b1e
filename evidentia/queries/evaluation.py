"""Evaluation, diagnostics, set and resume queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.text import normalize_answer
from ..operators import evaluation as E, joins as J, scoring as S
from ..session import table

QUERIES, SQL = {}, {}


def _query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SETS = """
WITH k AS (SELECT DISTINCT user_id FROM events), g AS (SELECT DISTINCT user_id, event_type AS x FROM events WHERE event_id % 3 = 0), p AS (SELECT DISTINCT user_id, event_type AS x FROM events WHERE event_id % 3 <> 0),
c AS (SELECT user_id, (SELECT count(*) FROM g WHERE g.user_id = k.user_id) AS g, (SELECT count(*) FROM p WHERE p.user_id = k.user_id) AS p, (SELECT count(*) FROM g JOIN p USING (user_id, x) WHERE user_id = k.user_id) AS c FROM k),
r AS (SELECT user_id, CASE WHEN g = 0 AND p = 0 THEN 1e0 WHEN p = 0 THEN 0e0 ELSE c / p::DOUBLE END AS precision, CASE WHEN g = 0 THEN 1e0 ELSE c / g::DOUBLE END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r)
"""


def _prf(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    keys = e.select("user_id").distinct()
    gold = keys.join(e.where("event_id % 3 = 0").select("user_id", F.col("event_type").alias("x")), "user_id", "left")
    return S.coverage(gold, e.where("event_id % 3 <> 0").select("user_id", F.col("event_type").alias("x")), "user_id", "x")  # every event has one of the two roles


@_query(_SETS + "SELECT user_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def prf_per_query(spark, sf_dir):
    return _prf(spark, sf_dir).select("user_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@_query(_SETS + "SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n FROM f")
def prf_macro(spark, sf_dir):
    return E.macro(_prf(spark, sf_dir))


@_query("SELECT o_orderstatus, count(*) AS n, round(avg((upper(trim(o_orderpriority)) = upper(CASE WHEN o_orderkey % 3 = 0 THEN '1-urgent' ELSE o_orderpriority || ' ' END))::INT), 6) AS strict, round(avg((lower(trim(o_orderpriority)) = lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN '1-urgent' ELSE o_orderpriority || ' ' END)))::INT), 6) AS loose FROM orders GROUP BY 1")
def answer_accuracy(spark, sf_dir):
    pred = F.when(F.col("o_orderkey") % 3 == 0, "1-urgent").otherwise(F.concat("o_orderpriority", F.lit(" ")))
    strict = F.upper(F.trim("o_orderpriority")) == F.upper(pred)
    loose = normalize_answer(F.col("o_orderpriority")) == normalize_answer(pred)
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg(strict.cast("int")), 6).alias("strict"), F.round(F.avg(loose.cast("int")), 6).alias("loose"))


_TABLE = """
WITH g AS (SELECT k, key, a, b FROM (SELECT l_orderkey AS k, 'row ' || l_linenumber AS key, l_quantity AS a, l_returnflag AS b, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 1000 + l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1),
p AS (SELECT k, key, a, b FROM (SELECT l_orderkey AS k, 'row ' || l_linenumber AS key, l_quantity + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN l_suppkey % 4 = 0 THEN 'Z' ELSE l_returnflag END AS b, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 1000 + l_suppkey DESC) AS rn FROM lineitem WHERE l_linenumber <> 2) WHERE rn = 1),
c AS (SELECT g.k, count(*) AS g, count(p.k) AS c, sum(coalesce((g.a = p.a)::INT, 0) + coalesce((lower(g.b) = lower(p.b))::INT, 0)) AS ok FROM g LEFT JOIN p ON g.k = p.k AND g.key = p.key GROUP BY g.k),
n AS (SELECT c.*, (SELECT count(*) FROM p WHERE p.k = c.k) AS p FROM c)
"""


@_query(_TABLE + """SELECT k, round(CASE WHEN p = 0 THEN 0e0 ELSE c / p::DOUBLE END, 6) AS precision, round(c / g::DOUBLE, 6) AS recall, ok::BIGINT AS cell_correct, (2 * g)::BIGINT AS cell_total FROM n""")
def table_row_scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    base = [F.col("l_orderkey").alias("k"), F.concat(F.lit("row "), F.col("l_linenumber")).alias("key"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("line")]
    gold = l.select(*base, F.col("l_quantity").alias("a"), F.col("l_returnflag").alias("b"))
    pred = l.where("l_linenumber <> 2").select(*base, (F.col("l_quantity") + F.when(F.col("l_partkey") % 5 == 0, 1).otherwise(0)).alias("a"), F.when(F.col("l_suppkey") % 4 == 0, "Z").otherwise(F.col("l_returnflag")).alias("b"))
    out = E.table_scores(gold, pred, "k", "key", {"a": "number", "b": "string"})
    return out.select("k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "cell_correct", "cell_total")


_HITS = "WITH h AS (SELECT user_id, event_type = 'purchase' AS relevant, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), p AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE rank <= 10) AS found, min(rank) AS first FROM h WHERE relevant GROUP BY user_id)"


@_query(_HITS + " SELECT round(avg(found / n::DOUBLE), 6) AS recall, round(avg((found = n)::INT), 6) AS full_coverage, round(avg((found > 0)::INT), 6) AS any_hit, round(avg(1e0 / first), 6) AS mrr, quantile_cont(first, 0.5)::DOUBLE AS median_rank, list_sort(list(first))[greatest(1, ceil(count(*) * 0.9e0 - 1e-9))::INT] AS p90_rank FROM p")
def rank_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hits = e.withColumn("rank", S.rank_by(["user_id"], F.desc("value"), F.asc("event_id"))).withColumn("relevant", F.col("event_type") == "purchase")
    return E.rank_metrics(hits, "user_id", 10)


@_query("SELECT event_type, list_sort(list(value))[greatest(1, ceil(count(*) * 0.9e0 - 1e-9))::INT] AS p90, list_sort(list(value))[greatest(1, ceil(count(*) * 0.5e0 - 1e-9))::INT] AS p50 FROM events GROUP BY 1")
def percentile_nearest_rank(spark, sf_dir):
    return S.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p90": 0.9, "p50": 0.5})


_FLAGS = "SELECT d.doc_id, d.lang, d.source, l.doc_id IS NOT NULL AS candidate, coalesce(l.quality = 1, false) AS available, n_chars > 1000 AS page, n_chars % 3 <> 0 AS typed, coalesce(l.toxic = 0, false) AS located, n_chars % 7 <> 0 AS chosen FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _flags(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels").withColumn("candidate", F.lit(True))
    rows = d.join(l, "doc_id", "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("doc_id", "lang", "source", no(F.col("candidate")).alias("candidate"), no(F.col("quality") == 1).alias("available"), (F.col("n_chars") > 1000).alias("page"), (F.col("n_chars") % 3 != 0).alias("typed"), no(F.col("toxic") == 0).alias("located"), (F.col("n_chars") % 7 != 0).alias("chosen"))


_SHARE = ", ".join(f"round(avg({f}::INT), 6) AS {f}" for f in ("candidate", "available", "page", "chosen"))


@_query(f"WITH f AS ({_FLAGS}) SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source END AS value, count(*) AS n, {_SHARE} FROM f GROUP BY GROUPING SETS ((), (lang), (source))")
def funnel_grouping_sets(spark, sf_dir):
    return E.funnel(_flags(spark, sf_dir), ["lang", "source"], ["candidate", "available", "page", "chosen"])


_CASE = "CASE " + " ".join(f"WHEN NOT {f} THEN '{n}'" for f, n in E.LADDER) + " ELSE 'selected' END"


@_query(f"WITH f AS ({_FLAGS}) SELECT {_CASE} AS stage, count(*) AS n FROM f GROUP BY 1")
def failure_stage_hist(spark, sf_dir):
    rows = _flags(spark, sf_dir)
    return rows.groupBy(E.failure_stage({f: F.col(f) for f, _ in E.LADDER}).alias("stage")).agg(F.count("*").alias("n"))


@_query("""
SELECT c_custkey::VARCHAR AS key, 'missing_prediction' AS rule FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_orderkey::VARCHAR, 'unknown_query' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)
UNION ALL SELECT o_custkey::VARCHAR, 'duplicate_query' FROM orders GROUP BY o_custkey HAVING count(*) > 20 UNION ALL SELECT l_orderkey || '-' || l_linenumber, 'bad_source_type' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')""")
def validator_violations(spark, sf_dir):
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    missing = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")
    known = c.where("c_custkey % 10 <> 3")
    unknown = o.join(known, o["o_custkey"] == known["c_custkey"], "left_anti")
    double = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 20")
    bad = l.where(~F.col("l_returnflag").isin("A", "N"))
    return E.violations(("missing_prediction", missing, F.col("c_custkey")), ("unknown_query", unknown, F.col("o_orderkey")), ("duplicate_query", double, F.col("o_custkey")), ("bad_source_type", bad, F.concat_ws("-", "l_orderkey", "l_linenumber")))


@_query("SELECT o_custkey AS query_id, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def resume_pending(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderkey % 5 = 0").select("o_custkey").distinct()
    return o.where("o_orderkey % 5 <> 0").join(done, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("query_id")).agg(F.count("*").alias("n"))


@_query("""
WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k, min(o_orderpriority) AS v FROM orders GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN coalesce(b.v, a.v, 'none') ELSE coalesce(a.v, b.v, 'none') END AS v, concat_ws('+', CASE WHEN a.k IS NOT NULL THEN 'a' END, CASE WHEN b.k IS NOT NULL THEN 'b' END) AS provenance FROM customer LEFT JOIN a ON a.k = c_custkey LEFT JOIN b ON b.k = c_custkey""")
def ensemble_coalesce(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    a = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("av"))
    b = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderpriority").alias("bv"))
    rows = c.select(F.col("c_custkey").alias("k")).join(a, "k", "left").join(b, "k", "left")
    v = F.when(F.col("k") % 3 == 0, F.coalesce("bv", "av", F.lit("none"))).otherwise(F.coalesce("av", "bv", F.lit("none")))
    return rows.select("k", v.alias("v"), F.concat_ws("+", F.when(F.col("av").isNotNull(), "a"), F.when(F.col("bv").isNotNull(), "b")).alias("provenance"))


@_query("SELECT o_custkey, o_orderkey, string_agg(s, ',' ORDER BY s) AS sources FROM (SELECT o_custkey, o_orderkey, 'even' AS s FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, 'odd' FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_custkey, o_orderkey, 'large' FROM orders WHERE o_totalprice > 150000) GROUP BY ALL")
def provenance_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = lambda condition: o.where(condition).select("o_custkey", "o_orderkey")
    rows = J.united({"even": own("o_orderkey % 2 = 0"), "odd": own("o_orderkey % 2 <> 0"), "large": own("o_totalprice > 150000")}, "o_custkey", "o_orderkey")
    return rows.withColumn("sources", F.array_join("sources", ","))


@_query("""
WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark), u AS (SELECT item_id, unnest(t) AS w, len(t) AS n FROM q), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
c AS (SELECT item_id, doc_id, count(*) / any_value(n)::DOUBLE AS part FROM u JOIN d USING (w) GROUP BY item_id, doc_id HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER o AS rn, lead(part) OVER o AS next FROM c WINDOW o AS (PARTITION BY item_id ORDER BY part DESC, doc_id))
SELECT item_id, doc_id, round(part, 6) AS containment FROM r WHERE rn = 1 AND part >= 0.8e0 AND part - coalesce(next, 0) >= 0.02e0""")
def containment_gap(spark, sf_dir):
    return J.containment_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), query="item_id", doc="doc_id")


@_query("SELECT user_id, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS kinds, min(length(props))::INT AS shortest FROM events GROUP BY 1")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.get_json_object("props", "$.k")).alias("kinds"), F.min(F.length("props")).alias("shortest"))


@_query("SELECT batch, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500 AS batch, o_orderstatus FROM orders) GROUP BY o_orderstatus, batch")
def fixed_batches(spark, sf_dir):
    rows = J.batches(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 500)
    return rows.groupBy("o_orderstatus", "batch").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"), F.count("*").alias("n")).drop("o_orderstatus")


@_query("SELECT o_custkey, o_orderkey, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= CASE WHEN o_custkey % 3 = 0 THEN 12 ELSE 5 END")
def top_k_per_query(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("place", S.rank_by(["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")))
    return rows.where(F.col("place") <= F.when(F.col("o_custkey") % 3 == 0, 12).otherwise(5)).select("o_custkey", "o_orderkey", "place")


@_query("WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY p_brand) AS top, count(*) OVER (PARTITION BY p_brand, n) AS ties FROM n) SELECT p_brand, p_type, n FROM t WHERE n = top AND ties = 1")
def unique_match_gate(spark, sf_dir):
    return J.unique_best(table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "p_brand", "n")


@_query("SELECT DISTINCT n.n_name, m.x FROM nation n JOIN (SELECT c_nationkey AS k, 'customer' AS x FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier) m ON n.n_nationkey = m.k")
def union_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("x"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("x"))
    n = table(spark, sf_dir, "nation")
    return n.join(c.unionByName(s).distinct(), n["n_nationkey"] == F.col("k")).select("n_name", "x")


@_query("SELECT source, doc_id, sha256(concat_ws('|', doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text)) AS fingerprint FROM documents")
def record_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "doc_id", J.fingerprint("doc_id", "source", "lang", "n_chars", "text").alias("fingerprint"))


@_query("WITH g AS (SELECT doc_id % 100 AS k, lang AS x, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL UNION ALL SELECT doc_id % 100, lang, count(*) FROM documents WHERE doc_id % 2 <> 0 GROUP BY ALL) SELECT k, x, sum(n)::BIGINT AS n FROM g GROUP BY ALL")
def histogram_merge(spark, sf_dir):
    """Two parts that hold each document once."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("k"), F.col("lang").alias("x"), F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)).alias("even"))
    part = lambda own: d.where(own).groupBy("k", "x").agg(F.count("*").alias("n"))
    return J.merged_counts([part(F.col("even")), part(~F.col("even"))], ["k", "x"])


@_query("SELECT nation, n AS n, place FROM (SELECT c_nationkey AS nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS place FROM customer GROUP BY 1) WHERE place <= 10")
def ranked_breakdown(spark, sf_dir):
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "nation").limit(10)  # ten rows
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "nation")).cast("long"))
