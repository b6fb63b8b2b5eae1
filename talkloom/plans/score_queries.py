"""Registered queries over scores, splits and quotas, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.functions import statistics as ST
from talkloom.operators import sampling as S
from talkloom.operators import scoring as SC
from talkloom.plans import entities as E
from talkloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DET = "WITH " + E.DETECTIONS_SQL
JUD = "WITH " + E.JUDGED_SQL
REC = "WITH " + E.RECORDS_SQL
_OFF = "position IS NULL"
CELLS = DET + """, c AS (SELECT baseline, count(*) FILTER (should_fire AND fired) AS tp, count(*) FILTER (should_fire AND NOT fired) AS fn, count(*) FILTER (NOT should_fire AND fired) AS fp, count(*) FILTER (NOT should_fire AND NOT fired) AS tn FROM detections GROUP BY 1),
r AS (SELECT *, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fp_rate, tp / nullif(tp + fp, 0) AS precision FROM c)"""


@query(DET + " SELECT id, CASE WHEN should_fire AND fired THEN 'tp' WHEN should_fire THEN 'fn' WHEN NOT should_fire AND fired THEN 'fp' WHEN NOT should_fire THEN 'tn' END AS verdict FROM detections")
def firing_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detections(spark, sf_dir).select("id", SC.verdict(F.col("fired"), F.col("should_fire")).alias("verdict"))


@query(CELLS.replace("detections GROUP BY 1)", f"detections WHERE NOT ({_OFF}) GROUP BY 1)") + f", o AS (SELECT baseline, count(*) FILTER (should_fire AND fired) / nullif(count(*) FILTER (should_fire), 0) AS off_recall FROM detections WHERE {_OFF} GROUP BY 1) SELECT baseline, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, coalesce(fp, 0) AS fp, coalesce(tn, 0) AS tn, round(recall, 6) AS recall, round(fp_rate, 6) AS fp_rate, round(precision, 6) AS precision, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1, round(off_recall, 6) AS off_recall FROM r FULL JOIN o USING (baseline)")
def persistent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SC.detection_summary(E.detections(spark, sf_dir), ["baseline"], off=F.col("position").isNull())
    return s.select("baseline", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in ("recall", "fp_rate", "precision", "f1", "off_recall")])


@query(CELLS + " SELECT baseline, round(coalesce(precision, 1.0), 6) AS precision, round(coalesce(2 * coalesce(precision, 1.0) * recall / nullif(coalesce(precision, 1.0) + recall, 0), 0.0), 6) AS f1 FROM r")
def sentinel_2x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SC.detection_summary(E.detections(spark, sf_dir), ["baseline"], precision_if_silent=1.0)
    return s.select("baseline", F.round("precision", 6).alias("precision"), F.round("f1", 6).alias("f1"))


@query(DET + " SELECT position::BIGINT AS position, count(*) AS n, round(avg(fired::int), 6) AS fire_rate FROM detections WHERE position IS NOT NULL GROUP BY 1")
def fire_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = E.detections(spark, sf_dir).where("position is not null")
    return d.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("fired").cast("int")), 6).alias("fire_rate"))


@query(JUD + " SELECT id, list_sort(list(score))[count(*)::INT // 2 + 1] AS median, count(*)::INT AS n_judges FROM judged WHERE score IS NOT NULL GROUP BY id")
def judge_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.upper_median(E.judged(spark, sf_dir), ["id"])


@query(JUD + ", v AS (SELECT id, score, count(*) AS n, min(judge_order) AS o FROM judged WHERE score IS NOT NULL GROUP BY 1, 2) SELECT id, arg_max(score, n * 100 - o) AS majority, sum(n)::BIGINT AS n_votes FROM v GROUP BY 1")
def judge_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.majority(E.judged(spark, sf_dir), ["id"], "score", "judge_order")


@query(JUD + " SELECT baseline, judge, count(*) AS n, count(score) AS n_scored, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS sd FROM judged GROUP BY 1, 2")
def multiseed_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = E.judged(spark, sf_dir).groupBy("baseline", "judge")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("n_scored"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("sd"))


@query(DET + " SELECT level, count(*) AS n, round(avg(fired::int), 6) AS fire_rate, round(avg(should_fire::int), 6) AS expected_rate, count(*) FILTER (doc_id % 5 > 0) AS n_valid, round(avg(CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END), 6) AS mean_score, round(avg((doc_id % 5 > 0)::int), 6) AS valid_rate FROM detections GROUP BY GROUPING SETS ((level), ())")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric tree by level and over all; score means over valid rows alone."""
    d = E.detections(spark, sf_dir).withColumn("score", F.expr("CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 END"))
    mean = lambda c: F.round(F.avg(c), 6)
    return d.rollup("level").agg(F.count(F.lit(1)).alias("n"), mean(F.col("fired").cast("int")).alias("fire_rate"), mean(F.col("should_fire").cast("int")).alias("expected_rate"), F.count("score").alias("n_valid"), mean("score").alias("mean_score"), mean(F.col("score").isNotNull().cast("int")).alias("valid_rate"))


@query(DET + " SELECT level, position::BIGINT AS position, count(*) AS n, count(*) FILTER (fired) AS n_fired FROM detections WHERE position IS NOT NULL GROUP BY CUBE (level, position)")
def recall_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.detections(spark, sf_dir).where("position is not null").cube("level", "position").agg(F.count(F.lit(1)).alias("n"), F.count_if("fired").alias("n_fired"))


@query(JUD + " SELECT judge, count(*) FILTER (score > 3) AS wins, count(*) FILTER (score = 3) AS ties, count(*) FILTER (score IS NULL) AS errors, round(count(*) FILTER (score > 3) / greatest(1, count(score)), 6) AS win_rate FROM judged GROUP BY 1")
def pairwise_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    return E.judged(spark, sf_dir).groupBy("judge").agg(F.count_if(s > 3).alias("wins"), F.count_if(s == 3).alias("ties"), F.count_if(s.isNull()).alias("errors"), F.round(F.count_if(s > 3) / F.greatest(F.lit(1), F.count(s)), 6).alias("win_rate"))


@query("WITH n AS (SELECT source AS name, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1) SELECT name, n, round(n / (SELECT sum(n) FROM n), 6) AS share, n / (SELECT sum(n) FROM n) > 0.25 AS warn FROM n ORDER BY n DESC, f LIMIT 10")
def diversity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "doc_id")
    return SC.first_seen_top(d, "name", "doc_id", 10).withColumn("share", F.round("share", 6))


_METRICS = "CASE level WHEN 'A1' THEN 'topic_adherence' WHEN 'A2' THEN 'above_band_ratio' WHEN 'B1' THEN 'json_validity' ELSE 'n_examples' END"
RUNS = DET + f", m AS (SELECT baseline AS section, {_METRICS} AS metric, avg(fired::int) AS value FROM detections GROUP BY 1, 2), p AS (SELECT * FROM m WHERE NOT (section = 'src1' AND metric = 'json_validity')), q AS (SELECT section, metric, value * 0.5 + 0.04 AS value FROM m WHERE section <> 'src2')"


@query(RUNS + """ SELECT coalesce(p.section, q.section) AS section, coalesce(p.metric, q.metric) AS metric, round(q.value - p.value, 6) AS delta,
  coalesce(CASE WHEN coalesce(p.metric, q.metric) IN ('topic_adherence', 'json_validity') THEN q.value - p.value < -0.05 WHEN coalesce(p.metric, q.metric) = 'above_band_ratio' THEN q.value - p.value > 0.05 ELSE abs(q.value - p.value) > 0.05 END, false) AS regression
  FROM p FULL JOIN q ON p.section = q.section AND p.metric = q.metric""")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.detections(spark, sf_dir).groupBy(F.col("baseline").alias("section"), F.expr(_METRICS).alias("metric")).agg(F.avg(F.col("fired").cast("int")).alias("value"))
    base = m.where("not (section = 'src1' and metric = 'json_validity')")
    new = m.where("section <> 'src2'").withColumn("value", F.col("value") * 0.5 + 0.04)
    return SC.compare_runs(base, new, ["section"]).select("section", "metric", F.round("delta", 6).alias("delta"), "regression")


_KN = "WITH c AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 7 < 3) AS k, count(*) FILTER (doc_id % 5 = 0) AS k2 FROM documents GROUP BY 1)"


def _kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") % 7 < 3).alias("k"), F.count_if(F.col("doc_id") % 5 == 0).alias("k2"))


_Z = ST.Z95


@query(_KN + f" SELECT source, round(greatest(0, (k / n + {_Z * _Z} / (2 * n) - {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS low, round(least(1, (k / n + {_Z * _Z} / (2 * n) + {_Z} * sqrt(k / n * (1 - k / n) / n + {_Z * _Z} / (4.0 * n * n))) / (1 + {_Z * _Z} / n)), 6) AS high FROM c")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = ST.wilson(F.col("k"), F.col("n"))
    return _kn(spark, sf_dir).select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(_KN + " SELECT source, round((k / n - k2 / n) / sqrt((k + k2) / (2.0 * n) * (1 - (k + k2) / (2.0 * n)) * 2 / n), 6) AS z, 'Infinity'::DOUBLE AS z_none, NULL::DOUBLE AS z_none_null, round(k / n - k2 / n, 4) AS risk_difference, round(((k + 0.5) * (n - k2 + 0.5)) / ((n - k + 0.5) * (k2 + 0.5)), 2) AS odds_ratio, round(2 * asin(sqrt(k / n)) - 2 * asin(sqrt(k2 / n)), 3) AS cohens_h FROM c")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, k2 = F.col("k"), F.col("n"), F.col("k2")
    # both conventions where the standard error is 0: infinite, and undefined
    none, undefined = ST.two_proportion_z(n * 0, n, n * 0, n), ST.two_proportion_z(n * 0, n, n * 0, n, if_zero=None)
    return _kn(spark, sf_dir).select("source", F.round(ST.two_proportion_z(k, n, k2, n), 6).alias("z"), none.alias("z_none"), undefined.alias("z_none_null"), *[c.alias(a) for a, c in ST.effect_sizes(k, n, k2, n).items()])


_LF = "list_sum(list_transform(range(1, {x} + 1), lambda i: ln(i)))"


def _lf(x: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, ({x})::BIGINT + 1), lambda i: ln(i))), 0)"


@query(_KN + f""", t AS (SELECT source, k AS b, k2 AS c, k + k2 AS n, unnest(range(0, least(k, k2) + 1)) AS i FROM c) SELECT source, round(least(1.0, 2 * sum(exp({_lf('n')} - {_lf('i')} - {_lf('n - i')} - n * ln(2)))), 6) AS p FROM t GROUP BY 1""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kn(spark, sf_dir).select("source", F.round(ST.mcnemar_exact(F.col("k"), F.col("k2")), 6).alias("p"))


@query(_KN + f""", t AS (SELECT source, k AS a, n - k AS b, k2 AS c, n - k2 AS d, unnest(range(greatest(0, k + k2 - n), least(n, k + k2) + 1)) AS x FROM c),
l AS (SELECT source, x, a, {_lf('a + b')} + {_lf('c + d')} + {_lf('a + c')} + {_lf('b + d')} - {_lf('a + b + c + d')} - {_lf('x')} - {_lf('a + b - x')} - {_lf('a + c - x')} - {_lf('c + d - a - c + x')} AS lp FROM t)
SELECT source, round(least(1.0, sum(exp(lp)) FILTER (lp <= o + 1e-7)), 6) AS p FROM (SELECT *, max(lp) FILTER (x = a) OVER (PARTITION BY source) AS o FROM l) GROUP BY 1""")
def fisher_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n, k2 = F.col("k"), F.col("n"), F.col("k2")
    return _kn(spark, sf_dir).select("source", F.round(ST.fisher_exact(k, n - k, k2, n - k2), 6).alias("p"))


@query(JUD + ", p AS (SELECT id, max(score) FILTER (judge = 'judge_a') AS a, max(score) FILTER (judge = 'judge_b') AS b, any_value(baseline) AS baseline FROM judged GROUP BY 1) SELECT baseline, count(*) FILTER (a > 3 AND b > 3) AS both, count(*) FILTER (a > 3 AND b <= 3) AS only_a, count(*) FILTER (a <= 3 AND b > 3) AS only_b, count(*) FILTER (a <= 3 AND b <= 3) AS neither FROM p GROUP BY 1")
def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = E.judged(spark, sf_dir)
    a = j.where("judge = 'judge_a'").select("id", "baseline", F.col("score").alias("a"))
    b = j.where("judge = 'judge_b'").select("id", F.col("score").alias("b"))
    x, y = F.col("a") > 3, F.col("b") > 3
    return a.join(b, "id").groupBy("baseline").agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


# splits and quotas


@query(REC + " SELECT id, row_number() OVER (PARTITION BY level ORDER BY substr(sha256('hold::' || id), 1, 12), id) <= 10 AS held_out FROM records")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.holdout(E.records(spark, sf_dir), F.col("id"), "level", 10, "hold::").select("id", "held_out")


@query(REC + " SELECT id, stream, level FROM (SELECT *, row_number() OVER (PARTITION BY stream, level ORDER BY id) AS r FROM records) WHERE r <= 10")
def cap_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_per_cell(E.records(spark, sf_dir), ["stream", "level"], ["id"], 10).select("id", "stream", "level")


@query(REC + " SELECT id, row_number() OVER (PARTITION BY stream, level ORDER BY substr(sha256(id), 1, 16), id) <= greatest(1, round_even(count(*) OVER (PARTITION BY stream, level) * 0.05, 0)::INT) AS validation FROM records")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_split(E.records(spark, sf_dir), ["stream", "level"], F.col("id"), 0.05).select("id", "validation")


_POOL = "CASE WHEN doc_id % 10 < 6 THEN 'register' WHEN doc_id % 10 < 8 THEN 'on_policy' ELSE 'sentinel' END"
_SHARES = {"register": 0.65, "on_policy": 0.25, "sentinel": 0.10}


@query(REC + f", p AS (SELECT id, {_POOL} AS pool FROM records), n AS (SELECT pool, count(*) AS n, CASE pool WHEN 'register' THEN 0.65::double WHEN 'on_policy' THEN 0.25 ELSE 0.1 END AS s FROM p GROUP BY 1), t AS (SELECT min(n / s) AS t FROM n) SELECT id, pool FROM (SELECT p.*, row_number() OVER (PARTITION BY pool ORDER BY substr(sha256(id), 1, 16), id) AS r FROM p) JOIN n USING (pool), t WHERE r <= least(n, floor(t * s + 1e-9))")
def mix_preference_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.records(spark, sf_dir).select("id", F.expr(_POOL).alias("pool"))
    return S.mix_pools(p, "pool", _SHARES, F.col("id"))


_PART = "CASE WHEN doc_id % 3 = 0 THEN 'sft' WHEN doc_id % 3 = 1 THEN 'dpo' ELSE 'eval' END"
_GRID = f"(SELECT unnest({E.LEVELS}) AS level) a, (SELECT unnest({E.CATEGORIES[:10]}) AS category) b"


@query(REC + f", c AS (SELECT level, category, {_PART} AS pool, count(*) AS n FROM records WHERE category <> 'general' GROUP BY 1, 2, 3), g AS (SELECT a.level, b.category FROM {_GRID}), w AS (SELECT g.level, g.category, coalesce(sum(n) FILTER (pool = 'sft'), 0)::BIGINT AS sft, coalesce(sum(n) FILTER (pool = 'dpo'), 0)::BIGINT AS dpo, coalesce(sum(n) FILTER (pool = 'eval'), 0)::BIGINT AS eval FROM g LEFT JOIN c USING (level, category) GROUP BY 1, 2) SELECT *, greatest(0, 5 - sft, 5 - dpo, 5 - eval)::BIGINT AS raw_deficit, least(10, greatest(0, 5 - sft, 5 - dpo, 5 - eval))::BIGINT AS deficit FROM w")
def coverage_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = E.records(spark, sf_dir).where("category <> 'general'").groupBy("level", "category", F.expr(_PART).alias("pool")).agg(F.count(F.lit(1)).alias("n"))
    grid = E.grid(spark, level=E.LEVELS, category=E.CATEGORIES[:10])
    return S.coverage_deficits(counts, grid, ["level", "category"], ["sft", "dpo", "eval"], 5, 10)


@query(REC + ", f AS (SELECT stream AS file, count(*) AS n FROM records GROUP BY 1), r AS (SELECT *, round_even(n / sum(n) OVER () * 70, 0)::BIGINT AS t FROM f), s AS (SELECT *, 70 - sum(t) OVER () AS l, row_number() OVER (ORDER BY n DESC, file) AS k FROM r) SELECT file, n, (t + CASE WHEN k <= abs(l) THEN sign(l) ELSE 0 END)::BIGINT AS take FROM s")
def proportional_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.proportional_cap(E.records(spark, sf_dir).groupBy(F.col("stream").alias("file")).agg(F.count(F.lit(1)).alias("n")), 70)


@query(REC + " SELECT level, locale, category, count(*) AS n FROM records WHERE locale IS NOT NULL AND category <> 'general' GROUP BY 1, 2, 3")
def count_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.records(spark, sf_dir).where("locale is not null and category <> 'general'").groupBy("level", "locale", "category").agg(F.count(F.lit(1)).alias("n"))


@query(REC + ", n AS (SELECT id, level, (row_number() OVER (PARTITION BY level ORDER BY substr(sha256('asr::' || id), 1, 16), id) - 1) AS r FROM records) SELECT id, ['food', 'place', 'brand', 'person'][r % 4 + 1] AS trigger, (r // 8)::BIGINT AS batch FROM n WHERE substr(id, 16, 1) <> '0'")
def trigger_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds in turn over each level's seeds in hash order."""
    from talkloom.functions import hashing as H

    # the cycle advances over ids that are done already, which go only afterwards
    d = S.ranked(E.records(spark, sf_dir), ["level"], H.prefix(F.concat(F.lit("asr::"), "id"), 16), F.col("id")).withColumn("r", F.col("_r") - 1)
    kinds = F.array(*[F.lit(x) for x in ("food", "place", "brand", "person")])
    return d.where(F.substring("id", 16, 1) != "0").select("id", F.get(kinds, (F.col("r") % 4).cast("int")).alias("trigger"), F.floor(F.col("r") / 8).alias("batch"))


@query(REC + ", p AS (SELECT id, level, CASE WHEN doc_id % 3 = 0 THEN 'evaluation' ELSE 'sft' END AS type FROM records), n AS (SELECT count(*) FILTER (type = 'sft') AS s, count(*) FILTER (type = 'evaluation') AS e FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY substr(sha256(id), 1, 16), id) AS k FROM p), t AS (SELECT r.* FROM r, n WHERE type = 'sft' OR k <= floor(s * (0.2 / 0.8))) SELECT id, type, row_number() OVER (PARTITION BY type, level ORDER BY substr(sha256(id), 1, 16), id) <= greatest(1, round_even(count(*) OVER (PARTITION BY type, level) * 0.05, 0)::INT) AS validation FROM t")
def mix_and_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: two pools trimmed to 80:20, then split by type and level."""
    r = E.records(spark, sf_dir)
    return S.mix_and_split(r.where("doc_id % 3 <> 0"), r.where("doc_id % 3 = 0"), F.col("id"), (0.8, 0.2), 0.05).select("id", "type", "validation")


@query("WITH " + E.RECORDS_SQL + " SELECT id, level FROM records WHERE ('0x' || substr(sha256(substr(id, 5)), 1, 8))::BIGINT % 100 >= 20 OR stream = 'normal'")
def exclude_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from talkloom.functions import hashing as H

    r = E.records(spark, sf_dir).withColumn("seed", F.when(F.col("stream") != "normal", F.regexp_extract("id", r"([0-9a-f]{12})(?:_v\d+)?$", 1)))
    held = r.where("seed is not null").select("seed").where(H.in_pool(F.col("seed"), 20)).distinct()
    return r.join(held, "seed", "left_anti").select("id", "level")  # rows without a seed id stay
