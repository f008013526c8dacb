"""Sequence review, batches, splits, run alignment, contrasts, calibration, task evaluation and transport."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.catalog.registry import query
from eventide.catalog.sequences import _TOKENS, _VOCAB, _sequences, _tokens
from eventide.catalog.statistics import _ARMS, _SCORES, _WEIGHT, _arms, _scores
from eventide.functions import numbers as N
from eventide.operators import inference as I
from eventide.operators import rollouts as R
from eventide.operators import statistics as S
from eventide.runtime import read
from eventide.sources import tables

# ---- sequences ------------------------------------------------------------------------

_WALK = "(SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type = 'error' THEN '<unk>' WHEN event_type = 'signup' THEN 'signup' ELSE event_type || '#' || CAST(CAST(floor(value / 40) AS INTEGER) AS VARCHAR) END AS token, event_type AS concept, CAST(floor(value / 40) AS INTEGER) AS bin FROM events)"
_BINS = {"view": 6, "click": 4, "purchase": 8}


def _walk(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    kind = F.col("event_type")
    token = F.when(kind == "error", "<unk>").when(kind == "signup", "signup").otherwise(F.concat(kind, F.lit("#"), F.floor(F.col("value") / 40).cast("int").cast("string")))
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return read(spark, d, "events").select(F.col("user_id").alias("key"), pos.alias("pos"), token.alias("token"))


@query(
    "sta_21_sequence_review",
    f"""WITH w AS (SELECT key, pos, token, CASE WHEN token = '<unk>' THEN '<unk>' ELSE concept END AS concept, CASE WHEN token LIKE '%#%' THEN bin END AS bin FROM {_WALK}), b AS (SELECT * FROM (VALUES ('view', 6), ('click', 4), ('purchase', 8)) AS t(c, bins)),
        g AS (SELECT key, COUNT(*) AS n_tokens, COUNT(DISTINCT token) AS n_unique, COUNT(*) FILTER (bin >= 7) AS unknown, COUNT(*) FILTER (bin >= bins) AS invalid_bins, COUNT(*) FILTER (token = '<unk>') AS structural, bool_or(concept = 'signup') AS in_context FROM w LEFT JOIN b ON c = concept GROUP BY 1),
        o AS (SELECT key, pos, token, pos - row_number() OVER (PARTITION BY key, token ORDER BY pos) AS i FROM w), r AS (SELECT key, max(n) AS longest_run FROM (SELECT key, token, i, COUNT(*) AS n FROM o GROUP BY 1, 2, 3) GROUP BY 1),
        l AS (SELECT key, max(n) AS most_in_window FROM (SELECT key, COUNT(*) OVER (PARTITION BY key, concept ORDER BY pos RANGE BETWEEN 7 PRECEDING AND CURRENT ROW) AS n FROM w) GROUP BY 1)
        SELECT g.*, false AS after_end, longest_run, most_in_window, CASE WHEN unknown + invalid_bins + structural > 0 THEN 'poor' WHEN longest_run >= 4 OR most_in_window >= 6 THEN 'review' ELSE 'good' END AS status,
        round(greatest(1.0::DOUBLE - least(0.55, unknown / n_tokens * 1.2) - least(0.35, invalid_bins / n_tokens * 1.5) - least(0.25, structural / n_tokens) - CASE WHEN longest_run >= 4 THEN 0.08 ELSE 0 END - CASE WHEN most_in_window >= 6 THEN 0.05 ELSE 0 END - CASE WHEN in_context THEN 0 ELSE 0.02 END, 0) + 1e-9, 4) AS score
        FROM g JOIN r USING (key) JOIN l USING (key)""",
)
def sta_21(spark: SparkSession, d: str) -> DataFrame:
    """Structural review of sequences: unknown tokens, bins a concept does not have, marks, runs and loops."""
    vocab = spark.createDataFrame([("<unk>",), ("signup",), *[(f"{c}#{b}",) for c in _BINS for b in range(7)]], "token string")
    return R.review(_walk(spark, d), vocab, spark.createDataFrame(list(_BINS.items()), "concept string, bins int"), "signup")


@query(
    "sta_36_sequence_summary",
    f"WITH w AS {_WALK}, o AS (SELECT key, token, pos - row_number() OVER (PARTITION BY key, token ORDER BY pos) AS i FROM w) SELECT key, CAST(COUNT(*) AS BIGINT) AS n_runs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS longest FROM (SELECT key, token, i, COUNT(*) AS n FROM o GROUP BY 1, 2, 3) GROUP BY 1",
)
def sta_36(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal tokens of every sequence."""
    from eventide.operators.windows import runs

    return runs(_walk(spark, d), ["key"], ["pos"], "token", "pos").groupBy("key").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


@query(
    "gen_03_stop_classes",
    f"""WITH {_TOKENS}, {_VOCAB}, e AS (SELECT h AS key, row_number() OVER (PARTITION BY h ORDER BY tm, i) AS pos, coalesce(v.id, 3) AS token FROM t LEFT JOIN v ON v.token = t.token), f AS (SELECT key, min(CASE WHEN token IN (5, 6, 9) THEN pos END) AS hit, max(pos) AS n FROM e GROUP BY 1)
        SELECT f.key, CASE WHEN hit IS NULL THEN 'censored' WHEN token IN (5, 6) THEN 'terminal' ELSE 'end' END AS stop, CASE WHEN token IN (5, 6) THEN token END AS terminal, coalesce(hit, n) AS step FROM f LEFT JOIN e ON e.key = f.key AND e.pos = f.hit""",
)
def gen_03(spark: SparkSession, d: str) -> DataFrame:
    """How sequences stop: on a terminal token, an end mark, or not."""
    rows = _sequences(spark, d).select(F.col("h").alias("key"), F.posexplode("token").alias("p", "token")).withColumn("pos", F.col("p") + 1)
    return R.stops(rows, [5, 6], [9])


@query(
    "gen_04_masked_probabilities",
    """WITH l AS (SELECT l_orderkey AS key, l_linenumber AS token, max(l_discount * 60 - 2) AS logit FROM lineitem WHERE l_linenumber <> 6 GROUP BY 1, 2), z AS (SELECT key, token, CASE WHEN token = 1 THEN CASE WHEN logit > 0 THEN logit / 1.5 ELSE logit * 1.5 END ELSE logit END / 0.7 AS z FROM l),
       k AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY z DESC, token) <= 4), p AS (SELECT key, token, z, exp(z - max(z) OVER (PARTITION BY key)) AS e FROM k), q AS (SELECT key, token, z, e / sum(e) OVER (PARTITION BY key) AS p FROM p),
       b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY key ORDER BY z DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
       SELECT key, token, round(p / sum(p) OVER (PARTITION BY key), 9) AS p FROM b WHERE before < 0.9""",
)
def gen_04(spark: SparkSession, d: str) -> DataFrame:
    """Next-token probabilities after a ban, a repetition penalty, temperature, the best four and a mass of 0.9."""
    logits = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("token")).agg(F.max(F.col("l_discount") * 60 - 2).alias("logit"))
    recent = logits.where("token = 1").select("key", "token")
    return R.next_probabilities(logits, temperature=0.7, forbidden=[6], recent=recent, penalty=1.5, top_k=4, top_p=0.9).withColumn("p", F.round("p", 9))


@query(
    "srt_04_token_batches",
    f"""WITH {_TOKENS}, n AS (SELECT h, COUNT(*) AS n FROM t GROUP BY 1), w AS (SELECT h, CAST(ceil(n / 4.0) * 4 AS BIGINT) AS width FROM n)
        SELECT h, width, CAST(floor((row_number() OVER (PARTITION BY width ORDER BY sha256('7:' || h), h) - 1) / greatest(floor(64.0 / width), 1)) AS BIGINT) AS batch FROM w""",
)
def srt_04(spark: SparkSession, d: str) -> DataFrame:
    """Sequences of like length in seeded order, in batches of at most 64 padded tokens."""
    n = _tokens(spark, d).groupBy("h").agg(F.count("*").alias("n"))
    return R.token_batches(n, "h", "n", 64, 4, seed=7)


@query(
    "win_09_budget_chunks",
    f"WITH {_TOKENS}, n AS (SELECT h, COUNT(*) AS n FROM t GROUP BY 1) SELECT h, CAST(floor((sum(n) OVER (ORDER BY sha256(h) ROWS UNBOUNDED PRECEDING) - n) / 100.0) AS BIGINT) AS chunk FROM n",
)
def win_09(spark: SparkSession, d: str) -> DataFrame:
    """Whole stays in chunks of about 100 events."""
    return R.budget_chunks(_tokens(spark, d).groupBy("h").agg(F.count("*").alias("n")), "h", "n", 100)


@query(
    "lab_16_continuation_headers",
    f"""WITH {_TOKENS}, {_VOCAB}, s AS (SELECT h, list(coalesce(v.id, 3) ORDER BY tm, i) AS a FROM t LEFT JOIN v ON v.token = t.token GROUP BY 1), w AS (SELECT h, a, unnest(range(0, len(a), 6)) AS st FROM s)
        SELECT h, CAST(st // 6 AS INTEGER) AS continuation_index, array_to_string(CASE WHEN st > 0 THEN list_concat(a[1:2], a[st + 1 : st + 6]) ELSE a[1:6] END, ',') AS ids FROM w""",
)
def lab_16_headers(spark: SparkSession, d: str) -> DataFrame:
    """Windows with the first two tokens put again before those that continue a stay."""
    from eventide.operators import encode

    s = _sequences(spark, d).select("h", "token", F.slice("token", 1, 2).alias("header"))
    w = R.with_header(encode.windows(s, ["token"], 6), "token", F.col("header"), "continuation_index")
    return w.select("h", "continuation_index", F.array_join(F.transform("token", lambda x: x.cast("string")), ",").alias("ids"))


# ---- splits ---------------------------------------------------------------------------

_HELD = "(SELECT patient_id, sex_category, row_number() OVER (PARTITION BY sex_category ORDER BY sha256('hold:' || patient_id), patient_id) - 1 < round(COUNT(*) OVER (PARTITION BY sex_category) * 0.2) AS held_out, ('0x' || substr(sha256('hold:' || patient_id), 1, 8))::UBIGINT / 4294967296.0 < 0.2 AS first_choice FROM patient)"


def _held(spark: SparkSession, d: str) -> DataFrame:
    return R.hold_out(read(spark, d, "patient"), "patient_id", "sex_category", 0.2, "hold")


@query("spl_02_stratified_hold_out", f"SELECT patient_id, sex_category, held_out, held_out <> first_choice AS moved FROM {_HELD}")
def spl_02(spark: SparkSession, d: str) -> DataFrame:
    """A fifth of each stratum held out, and who was moved in or out to meet it."""
    return _held(spark, d)


@query("agg_20_held_out_shares", f"SELECT sex_category AS arm, COUNT(*) AS n, round(avg(CASE WHEN held_out THEN 1.0 ELSE 0.0 END), 9) AS share, COUNT(*) FILTER (held_out <> first_choice) AS n_moved FROM {_HELD} GROUP BY 1")
def agg_20(spark: SparkSession, d: str) -> DataFrame:
    """Part of each arm held out."""
    return _held(spark, d).groupBy(F.col("sex_category").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("held_out"), 1.0).otherwise(0.0)), 9).alias("share"), F.count_if("moved").alias("n_moved"))


@query(
    "rpt_03_preflight",
    f"""WITH {_TOKENS}, n AS (SELECT h, COUNT(*) AS n FROM t GROUP BY 1), o AS (SELECT hospitalization_id AS h, min(patient_id) AS p FROM hospitalization WHERE hospitalization_id IS NOT NULL GROUP BY 1),
        j AS (SELECT n.h, n, CASE WHEN p IS NULL THEN 'none' WHEN held_out THEN 'held out' ELSE 'train' END AS part FROM n LEFT JOIN o ON o.h = n.h LEFT JOIN {_HELD} s ON s.patient_id = p)
        SELECT part AS "partition", COUNT(*) AS stays, CAST(sum(n) AS BIGINT) AS tokens, min(n) AS shortest, max(n) AS longest, quantile_cont(n, 0.99) AS p99 FROM j GROUP BY 1""",
)
def rpt_03(spark: SparkSession, d: str) -> DataFrame:
    """Stays, tokens and lengths of each partition of the encoded stays; stays without a partition are told."""
    owner = read(spark, d, "hospitalization").where("hospitalization_id is not null").groupBy(F.col("hospitalization_id").alias("h")).agg(F.min("patient_id").alias("patient_id"))
    n = _tokens(spark, d).groupBy("h").agg(F.count("*").alias("n")).join(owner, "h", "left").join(_held(spark, d).select("patient_id", "held_out"), "patient_id", "left")
    part = F.when(F.col("patient_id").isNull(), "none").when(F.col("held_out"), "held out").otherwise("train")
    return n.groupBy(part.alias("partition")).agg(F.count("*").alias("stays"), F.sum("n").alias("tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.percentile("n", 0.99).alias("p99"))


# ---- runs, contrasts, calibration -----------------------------------------------------

_RUNS = "(SELECT l_returnflag AS cell, l_orderkey AS pair, CAST(l_linenumber % 3 AS VARCHAR) AS run, CASE WHEN l_returnflag = 'N' THEN l_linenumber % 2 ELSE 1 END AS label, avg(l_discount) AS score FROM lineitem WHERE l_returnflag <> 'A' OR l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1 HAVING COUNT(DISTINCT l_linenumber % 3) = 3) GROUP BY 1, 2, 3, 4)"


def _run_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_orderkey").alias("pair"), (F.col("l_linenumber") % 3).cast("string").alias("run"), F.when(F.col("l_returnflag") == "N", F.col("l_linenumber") % 2).otherwise(1).alias("label"), "l_discount")
    whole = rows.where("cell = 'A'").groupBy("pair").agg(F.count_distinct("run").alias("r")).where("r = 3").select("pair")
    kept = rows.where("cell <> 'A'").unionByName(rows.where("cell = 'A'").join(whole, "pair", "left_semi").select(rows.columns))
    return kept.groupBy("cell", "pair", "run", "label").agg(F.avg("l_discount").alias("score"))


@query(
    "join_14_align_runs",
    f"""WITH p AS (SELECT cell, pair, COUNT(DISTINCT run) AS r, COUNT(*) AS k, min(label) = max(label) AS same FROM {_RUNS} GROUP BY 1, 2)
        SELECT cell, COUNT(*) AS pairs, CASE WHEN NOT bool_and(same) THEN 'labels differ' WHEN NOT bool_and(k = r) THEN 'repeated' WHEN NOT bool_and(r = 3) THEN 'incomplete' ELSE 'aligned' END AS status FROM p GROUP BY 1""",
)
def join_14(spark: SparkSession, d: str) -> DataFrame:
    """Whether every run scored the same pairs with the same labels; one cell is aligned, one lacks runs, one has other labels."""
    return I.align_runs(_run_rows(spark, d), ["cell"], "pair", "run", "label", ["0", "1", "2"])


@query("join_14_aligned_scores", f"SELECT cell, pair, label, round(max(score) FILTER (run = '0'), 9) AS \"0\", round(max(score) FILTER (run = '1'), 9) AS \"1\", round(max(score) FILTER (run = '2'), 9) AS \"2\" FROM {_RUNS} WHERE cell = 'A' GROUP BY 1, 2, 3")
def join_14_scores(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair of the aligned cells, a column per run."""
    out = I.aligned_scores(_run_rows(spark, d), ["cell"], "pair", "run", "label", "score", ["0", "1", "2"])
    return out.select("cell", "pair", "label", *[F.round(F.col(f"`{r}`"), 9).alias(r) for r in ("0", "1", "2")])


@query(
    "sta_12_weighted_clones",
    """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS arm, CAST(o_orderkey % 50 AS DOUBLE) AS t, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END AS y FROM orders), c AS (SELECT *, unnest(['F', 'O']) AS a FROM p),
       x AS (SELECT a, y, NOT (t <= 24 AND arm = a) AS cens, least(t, 24) AS t FROM c), g AS (SELECT a, t, COUNT(*) AS n, COUNT(*) FILTER (cens) AS c FROM x GROUP BY 1, 2),
       r AS (SELECT *, sum(n) OVER (PARTITION BY a ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM g), s AS (SELECT a, t, coalesce(sum(CASE WHEN c < risk THEN ln(1 - c / risk) ELSE -700 END) OVER (PARTITION BY a ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
       SELECT a AS clone_arm, COUNT(*) AS clones, COUNT(*) FILTER (NOT cens) AS followed, round(sum(exp(-b)) FILTER (NOT cens), 4) AS weight, round(sum(exp(-b) * y) FILTER (NOT cens) / sum(exp(-b)) FILTER (NOT cens), 8) AS risk FROM x JOIN s USING (a, t) GROUP BY 1""",
)
def sta_12_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Risk of the clones that follow their arm, weighted for those censored when they left it."""
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 50).cast("double").alias("t"), F.when(F.col("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("y"))
    clones = S.clones(rows, "arm", "t", ["F", "O"], 24).withColumn("at", F.coalesce("censored_at", "t")).withColumn("left", ~F.col("follows"))
    w = S.censoring_weights(clones.select("clone_arm", "at", "left", "y"), "clone_arm", "at", "left")
    g = w.groupBy("clone_arm").agg(F.count("*").alias("clones"), F.count_if(~F.col("left")).alias("followed"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("y")).alias("s"))
    return g.select("clone_arm", "clones", "followed", F.round("w", 4).alias("weight"), F.round(F.col("s") / F.col("w"), 8).alias("risk"))


_CLUSTERED = "(SELECT CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS a, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, 0.2 + l_discount * 5 AS e, l_suppkey AS c FROM lineitem)"


@query(
    "sta_13_clustered_contrast",
    f"""WITH w AS (SELECT *, {_WEIGHT} AS w FROM {_CLUSTERED}), m AS (SELECT sum(w) FILTER (a = 1) AS w1, sum(w * y) FILTER (a = 1) / sum(w) FILTER (a = 1) AS r1, sum(w) FILTER (a = 0) AS w0, sum(w * y) FILTER (a = 0) / sum(w) FILTER (a = 0) AS r0 FROM w),
        i AS (SELECT c, sum(CASE WHEN a = 1 THEN w * (y - r1) / w1 ELSE 0 END) AS p1, sum(CASE WHEN a = 0 THEN w * (y - r0) / w0 ELSE 0 END) AS p0 FROM w, m GROUP BY 1),
        s AS (SELECT sqrt(sum(pow(p1 - p0, 2)) * COUNT(*) / (COUNT(*) - 1)) AS se, sqrt(sum(pow(p1 / r1 - p0 / r0, 2)) * COUNT(*) / (COUNT(*) - 1)) AS sl, COUNT(*) AS clusters FROM i, m)
        SELECT round(r1, 8) AS risk_1, round(r0, 8) AS risk_0, round(r1 - r0, 8) AS difference, round(se, 8) AS se, round(r1 - r0 - 1.959963984540054 * se, 8) AS lo, round(r1 - r0 + 1.959963984540054 * se, 8) AS hi, round(r1 / r0, 8) AS ratio, round(r1 / r0 * exp(-1.959963984540054 * sl), 8) AS ratio_lo, round(r1 / r0 * exp(1.959963984540054 * sl), 8) AS ratio_hi, clusters FROM m, s""",
)
def sta_13_clustered(spark: SparkSession, d: str) -> DataFrame:
    """Weighted risks of two arms with errors clustered by supplier."""
    rows = read(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("a"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"), (F.lit(0.2) + F.col("l_discount") * 5).alias("e"), F.col("l_suppkey").alias("c"))
    out = I.clustered_contrast(rows.withColumn("w", S.ipw(F.col("e"), F.col("a"), clip=0.05)), "y", "a", "w", "c")
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns if c != "clusters"], "clusters")


@query(
    "sta_13_overlap_weights",
    f"WITH w AS (SELECT *, CASE WHEN a = 1 THEN 1 - e ELSE e END AS w FROM {_ARMS}) SELECT round(sum(w * y) FILTER (a = 1) / sum(w) FILTER (a = 1) - sum(w * y) FILTER (a = 0) / sum(w) FILTER (a = 0), 9) AS difference FROM w",
)
def sta_13_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Contrast under overlap weights."""
    rows = _arms(spark, d).withColumn("w", S.overlap_weight(F.col("e"), F.col("a")))
    return S.hajek(rows, "y", "a", "w").select(F.round("difference", 9).alias("difference"))


@query(
    "sta_14_overlap",
    f"WITH w AS (SELECT *, {_WEIGHT} AS w FROM {_ARMS}) SELECT a AS arm, COUNT(*) AS n, round(quantile_cont(e, 0.05), 9) AS q05, round(quantile_cont(e, 0.5), 9) AS median, round(quantile_cont(e, 0.95), 9) AS q95, round(avg(CASE WHEN e BETWEEN 0.25 AND 0.6 THEN 0.0 ELSE 1.0 END), 9) AS outside, round(pow(sum(w), 2) / sum(w * w), 3) AS ess FROM w GROUP BY 1",
)
def sta_14_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How far the arms' propensities overlap."""
    out = I.overlap(_arms(spark, d), "e", "a", "w", (0.25, 0.6))
    return out.select("arm", "n", *[F.round(c, 9).alias(c) for c in ("q05", "median", "q95", "outside")], F.round("ess", 3).alias("ess"))


@query(
    "sta_14_minimal_effect",
    "SELECT l_returnflag AS g, round((1.959963984540054 + 0.8416212335729143) * sqrt(avg(y) FILTER (a = 0) * (1 - avg(y) FILTER (a = 0)) * (1.0 / COUNT(*) FILTER (a = 1) + 1.0 / COUNT(*) FILTER (a = 0))), 9) AS effect FROM (SELECT l_returnflag, CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS a, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY 1",
)
def sta_14_effect(spark: SparkSession, d: str) -> DataFrame:
    """Smallest difference each group's arms would show."""
    a, y = F.col("l_tax") > 0.04, F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0)
    g = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count_if(a).alias("n1"), F.count_if(~a).alias("n0"), F.avg(F.when(~a, y)).alias("r"))
    return g.select("g", F.round(I.minimal_effect(F.col("n1"), F.col("n0"), F.col("r")), 9).alias("effect"))


@query(
    "sta_10_decile_slope",
    f"""WITH s AS (SELECT p, y FROM {_SCORES}), e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s), b AS (SELECT p, y, len(list_filter(e, lambda x: x < p)) AS t FROM s, e WHERE p > 0), m AS (SELECT t, avg(p) AS x, avg(y) AS y FROM b GROUP BY 1 HAVING COUNT(*) >= 5)
        SELECT round(regr_slope(y, x), 7) AS slope, COUNT(*) AS n_deciles FROM m""",
)
def sta_10_slope(spark: SparkSession, d: str) -> DataFrame:
    """Slope of observed on predicted tenths."""
    return I.decile_slope(_scores(spark, d), "p", "y").select(F.round("slope", 7).alias("slope"), "n_deciles")


@query(
    "sta_22_bootstrap_summary",
    "SELECT o_orderstatus AS g, COUNT(*) AS draws, round(least(1.0, greatest(2 * least(avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END)), 1.0 / COUNT(*))), 9) AS p, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM (SELECT o_orderstatus, o_totalprice - 90000.0 AS v FROM orders) GROUP BY 1",
)
def sta_22_summary(spark: SparkSession, d: str) -> DataFrame:
    """P-value and interval of draws."""
    out = I.bootstrap_summary(read(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_totalprice") - 90000.0).alias("v")), "v", ["g"])
    return out.select("g", "draws", F.round("p", 9).alias("p"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("sta_22_false_coverage", "SELECT l_returnflag AS g, round(1 - 0.05 * greatest(COUNT(*) FILTER (l_discount < 0.02), 1) / COUNT(*), 9) AS level FROM lineitem GROUP BY 1")
def sta_22_fcr(spark: SparkSession, d: str) -> DataFrame:
    """Level of the intervals of rejected tests."""
    g = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.count_if(F.col("l_discount") < 0.02).alias("r"), F.count("*").alias("m"))
    return g.select("g", F.round(I.false_coverage_level(0.05, F.col("r"), F.col("m")), 9).alias("level"))


@query(
    "sta_18_group_rates",
    """WITH c AS (SELECT l_returnflag || l_linestatus AS i, l_linenumber % 2 AS h, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT CASE WHEN i IN ('NO', 'NF') THEN 'new' WHEN i = 'AF' THEN 'old' ELSE 'other' END AS g, h, sum(n) / sum(sum(n)) OVER (PARTITION BY h) AS r FROM c GROUP BY 1, 2)
       SELECT g AS "group", round(coalesce(max(r) FILTER (h = 0), 0), 9) AS real, round(coalesce(max(r) FILTER (h = 1), 0), 9) AS generated, round(max(r) FILTER (h = 1) / max(r) FILTER (h = 0), 9) AS ratio FROM g GROUP BY 1""",
)
def sta_18_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rates of token groups on two sides."""
    rows = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("i"), (F.col("l_linenumber") % 2).alias("h"))
    count = lambda h: rows.where(F.col("h") == h).groupBy("i").agg(F.count("*").alias("n"))
    out = I.group_rates(count(0), count(1), "i", spark.createDataFrame([("NO", "new"), ("NF", "new"), ("AF", "old")], "i string, group string"))
    return out.select("group", *[F.round(c, 9).alias(c) for c in ("real", "generated", "ratio")])


@query(
    "sta_20_modal_outcome",
    "WITH n AS (SELECT user_id, event_type, COUNT(*) AS n, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS p FROM events WHERE event_type IN ('purchase', 'signup', 'view') GROUP BY 1, 2) SELECT user_id, event_type AS modal, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, p) = 1",
)
def sta_20_modal(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent outcome of each entity's rollouts, ties by the order given."""
    return R.modal_outcome(read(spark, d, "events"), "user_id", "event_type", ["purchase", "signup", "view"])


@query("sta_37_curriculum", "SELECT o_orderkey, round(CASE WHEN o_orderkey < 1000 THEN 0.0 WHEN o_orderkey >= 5000 THEN 0.5 ELSE (o_orderkey - 1000) / 4000.0 * 0.5 END, 9) AS weight FROM orders")
def sta_37(spark: SparkSession, d: str) -> DataFrame:
    """Weight of a second objective by step."""
    return read(spark, d, "orders").select("o_orderkey", F.round(I.curriculum(F.col("o_orderkey"), 10_000, 0.1, 0.4, 0.5), 9).alias("weight"))


@query(
    "sta_38_losses",
    "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, max(l_discount * 40) AS z FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), g AS (SELECT k, ln(sum(exp(z))) AS lse, max(CASE WHEN i = 1 THEN z END) AS t FROM l GROUP BY 1) SELECT k, round(lse - t, 7) AS loss FROM g WHERE t IS NOT NULL",
)
def sta_38(spark: SparkSession, d: str) -> DataFrame:
    """Cross-entropy of the first item of each order among its logits."""
    one = read(spark, d, "lineitem").where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.max(F.col("l_discount") * 40).alias("z"))
    g = one.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "z"))).alias("a")).where("a[0].l_linenumber = 1")
    return g.select("k", F.round(I.cross_entropy(F.col("a.z"), F.lit(0)), 7).alias("loss"))


@query("sta_38_value_losses", "SELECT l_orderkey AS k, l_linenumber AS i, round(0.5 * (ln(2 * pi()) + l_discount * 10 + pow(l_tax - 0.04, 2) / exp(l_discount * 10)), 9) AS loss FROM lineitem")
def sta_38_value(spark: SparkSession, d: str) -> DataFrame:
    """Gaussian loss of values."""
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), F.round(I.gaussian_nll(F.col("l_tax"), F.lit(0.04), F.col("l_discount") * 10), 9).alias("loss"))


_COVERED = ["flow", "sweep", "fdo2", "device_rate"]


@query(
    "sta_32_coverage",
    "WITH g AS (SELECT mcs_group, COUNT(*) AS n, " + ", ".join(f"COUNT({c}) AS {c}" for c in _COVERED) + " FROM ecmo_mcs GROUP BY 1), l AS (" + " UNION ALL ".join(f"SELECT mcs_group, '{c}' AS \"column\", n, {c} AS k FROM g" for c in _COVERED)
    + ") SELECT mcs_group, \"column\", n, round(CASE WHEN NOT (n < 10 OR k BETWEEN 1 AND 9 OR n - k BETWEEN 1 AND 9) THEN k / n END, 9) AS share FROM l",
)
def sta_32(spark: SparkSession, d: str) -> DataFrame:
    """Part of each group's rows that have a value, small counts hidden."""
    return I.coverage(read(spark, d, "ecmo_mcs"), _COVERED, ["mcs_group"]).withColumn("share", F.round("share", 9))


# ---- fitted models --------------------------------------------------------------------


def _stay_features(spark: SparkSession, d: str) -> DataFrame:
    """Stays with their site, partition of the patient, outcome at discharge and counts of the first day."""
    rows = read(spark, d, "hospitalization").where("hospitalization_id is not null and admission_dttm is not null and discharge_category is not null")
    stays = rows.groupBy("hospitalization_id").agg(F.min(F.struct("admission_dttm", "patient_id", "hospital_id", "discharge_category", "age_at_admission")).alias("s")).select("hospitalization_id", "s.*")
    u = N.unit_interval(F.coalesce("patient_id", "hospitalization_id"), seed="role")
    part = F.when(u < 0.5, "train").when(u < 0.65, "selection").when(u < 0.8, "calibration").otherwise("test")
    labs = read(spark, d, "labs").where(N.finite(F.col("lab_value_numeric"))).select("hospitalization_id", "lab_result_dttm", "lab_category", "lab_value_numeric")
    day = labs.join(stays.select("hospitalization_id", "admission_dttm"), "hospitalization_id").where(F.col("lab_result_dttm") <= tables.with_lag(F.col("admission_dttm"), 1440))
    of = lambda c: F.avg(F.when(F.col("lab_category") == c, F.log1p(F.abs("lab_value_numeric")))).alias(c)
    counts = day.groupBy("hospitalization_id").agg(F.count("*").cast("double").alias("n_labs"), of("lactate"), of("creatinine"))
    joined = stays.join(counts, "hospitalization_id", "left").na.fill(0.0, ["n_labs", "lactate", "creatinine"])
    return joined.select("hospitalization_id", "patient_id", "hospital_id", part.alias("part"), (F.col("discharge_category") == "Expired").cast("int").alias("died"), F.coalesce(F.col("age_at_admission").cast("double"), F.lit(60.0)).alias("age"), "n_labs", "lactate", "creatinine")


_FEATURES = ["age", "n_labs", "lactate", "creatinine"]
_ROLES = {"fit": "train", "selection": "selection", "calibration": "calibration", "evaluation": "test"}


@query("lab_13_task_evaluation")
def lab_13(spark: SparkSession, d: str) -> DataFrame:
    """Death predicted from the first day: fitted, selected, calibrated and scored on partitions of their own (no SQL: fitted models)."""
    return I.evaluate_task(_stay_features(spark, d), _FEATURES, "died", "part", _ROLES)


@query("sta_24_transport_matrix")
def sta_24(spark: SparkSession, d: str) -> DataFrame:
    """The model of every hospital on the test stays of every other (no SQL: fitted models)."""
    rows = _stay_features(spark, d).withColumn("part", F.when(F.col("part") == "selection", "train").otherwise(F.col("part")))
    return I.transport_matrix(rows, _FEATURES, "died", "hospital_id", "part")


@query("sta_28_cross_fitted_risk")
def sta_28_cross(spark: SparkSession, d: str) -> DataFrame:
    """Doubly robust risk with both models cross-fitted by patient (no SQL: fitted models)."""
    rows = _stay_features(spark, d).where("patient_id is not null").withColumn("arm", (F.col("n_labs") > 2).cast("int"))
    return I.cross_fitted_risk(rows, ["age", "lactate", "creatinine"], "arm", "died", "patient_id", k=3)
