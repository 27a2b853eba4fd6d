"""Key-event queries: truth is a user's purchases, the prediction its signups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from .registry import query
from .scoring import rounded
from .tables import TRACK_SQL, load, track


def sides(spark, sf):
    t = track(spark, sf, "event_type")
    return t, t.where("event_type = 'signup'"), t.where("event_type = 'purchase'")


TOL1_SQL = f"""{TRACK_SQL}, ev AS (
  SELECT user_id, frame, event_type = 'signup' AS p FROM track WHERE event_type IN ('signup', 'purchase')), l AS (
  SELECT *, coalesce(lag(frame) OVER w = frame - 1 AND lag(p) OVER w <> p, false) AS linked
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY frame)), c AS (
  SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS chain FROM l), h AS (
  SELECT user_id, chain, count(*) // 2 AS hits FROM c GROUP BY ALL), n AS (
  SELECT user_id, count(*) FILTER (p) AS n_pred, count(*) FILTER (NOT p) AS n_truth FROM ev GROUP BY 1), m AS (
  SELECT n.user_id, n_pred, n_truth, CAST(sum(hits) AS BIGINT) AS hits FROM n JOIN h USING (user_id) GROUP BY ALL), s AS (
  SELECT *, CASE WHEN n_truth = 0 THEN 0 WHEN n_pred = 0 THEN 1 ELSE hits / n_pred END::DOUBLE AS precision,
         CASE WHEN n_truth = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE hits / n_truth END::DOUBLE AS recall,
         CASE WHEN n_truth = 0 OR n_pred = 0 THEN 0 ELSE 2 * hits / (n_pred + n_truth) END::DOUBLE AS f1 FROM m)"""


@query("match_tol1", f"""WITH {TOL1_SQL} SELECT user_id, n_pred, n_truth, hits, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s""")
def match_tol1(spark, sf):
    """Signups and purchases never share a frame, so a chain of k alternating events gives k div 2 hits."""
    _, pred, truth = sides(spark, sf)
    return rounded(E.match_events(pred, truth, ["user_id"], 1))


@query("match_exact", f"""WITH {TRACK_SQL}, pred AS (SELECT user_id, frame FROM track WHERE event_type IN ('signup', 'view')),
truth AS (SELECT user_id, frame FROM track WHERE event_type IN ('purchase', 'view')), n AS (
  SELECT user_id, (SELECT count(*) FROM pred p WHERE p.user_id = u.user_id) AS n_pred,
         (SELECT count(*) FROM truth t WHERE t.user_id = u.user_id) AS n_truth,
         (SELECT count(*) FROM pred p JOIN truth t USING (user_id, frame) WHERE user_id = u.user_id) AS hits
  FROM (SELECT DISTINCT user_id FROM track) u)
SELECT user_id, n_pred, n_truth, hits,
  round(CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0 ELSE 1 END WHEN n_pred = 0 THEN 1 ELSE hits / n_pred END::DOUBLE, 6) AS precision,
  round(CASE WHEN n_truth = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE hits / n_truth END::DOUBLE, 6) AS recall,
  round(CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0 ELSE 1 END WHEN n_pred = 0 THEN 0
        ELSE 2 * hits / (n_pred + n_truth) END::DOUBLE, 6) AS f1 FROM n""")
def match_exact(spark, sf):
    t = track(spark, sf, "event_type")
    return rounded(E.match_events(t.where("event_type IN ('signup', 'view')"),
                                  t.where("event_type IN ('purchase', 'view')"), ["user_id"], 0, t))


def greedy_sql(name: str, pred: str, truth: str, tol: int, tracks: str = "SELECT DISTINCT user_id FROM track") -> str:
    """The matching rule itself, pair by pair in its order, for tracks with events (or all of ``tracks``): CTEs that end in ``name``."""
    return f"""{name}_p AS ({pred}), {name}_t AS ({truth}), {name}_x AS (
  SELECT p.user_id, p.frame AS i, t.frame AS j, row_number() OVER (PARTITION BY p.user_id ORDER BY abs(p.frame - t.frame), p.frame, t.frame) AS k
  FROM {name}_p p JOIN {name}_t t ON t.user_id = p.user_id AND abs(p.frame - t.frame) <= {tol}), {name}_g AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, CAST([] AS INTEGER[]) AS ps, CAST([] AS INTEGER[]) AS ts FROM {name}_x
  UNION ALL SELECT g.user_id, x.k, CASE WHEN list_contains(ps, i) OR list_contains(ts, j) THEN ps ELSE list_append(ps, i) END,
         CASE WHEN list_contains(ps, i) OR list_contains(ts, j) THEN ts ELSE list_append(ts, j) END
  FROM {name}_g g JOIN {name}_x x ON x.user_id = g.user_id AND x.k = g.k + 1), {name}_n AS (
  SELECT u.user_id, (SELECT count(*) FROM {name}_p p WHERE p.user_id = u.user_id) AS n_pred, (SELECT count(*) FROM {name}_t t WHERE t.user_id = u.user_id) AS n_truth,
         coalesce((SELECT max(len(ps)) FROM {name}_g g WHERE g.user_id = u.user_id), 0) AS hits FROM ({tracks}) u), {name} AS (
  SELECT *, CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0 ELSE 1 END WHEN n_pred = 0 THEN 1 ELSE hits / n_pred END::DOUBLE AS precision,
         CASE WHEN n_truth = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE hits / n_truth END::DOUBLE AS recall,
         CASE WHEN n_truth = 0 THEN CASE WHEN n_pred > 0 THEN 0 ELSE 1 END WHEN n_pred = 0 THEN 0 ELSE 2 * hits / (n_pred + n_truth) END::DOUBLE AS f1 FROM {name}_n)"""


PRED_SQL, TRUE_SQL = (f"SELECT user_id, frame FROM track WHERE event_type = '{e}'" for e in ("signup", "purchase"))
EITHER_SQL = "SELECT DISTINCT user_id FROM track WHERE event_type IN ('signup', 'purchase')"
SCORED = "user_id, n_pred, n_truth, CAST(hits AS BIGINT) AS hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def drawn_sql(live: str, counts: str) -> str:
    """As many live frames as ``counts`` (user_id, n) asks for, by the order of their hashes."""
    return f"""SELECT user_id, frame FROM (
  SELECT user_id, frame, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || user_id || ':' || frame), frame) AS r FROM track WHERE {live})
  JOIN ({counts}) USING (user_id) WHERE r <= n"""


@query("match_tol2", f"WITH RECURSIVE {TRACK_SQL}, {greedy_sql('m', PRED_SQL, TRUE_SQL, 2, EITHER_SQL)} SELECT {SCORED} FROM m")
def match_tol2(spark, sf):
    """Wider tolerance."""
    _, pred, truth = sides(spark, sf)
    return rounded(E.match_events(pred, truth, ["user_id"], 2))


@query("truth_keys", f"""WITH {TRACK_SQL}, span AS (
  SELECT user_id, min(frame) AS lo, max(frame) AS hi FROM track WHERE event_type IN ('click', 'view') AND frame > 9 GROUP BY 1),
k AS (SELECT t.user_id, frame, lo, hi FROM track t JOIN span USING (user_id) WHERE event_type = 'purchase')
SELECT DISTINCT user_id, least(greatest(frame, lo), hi) AS frame, 'clipped' AS mode FROM k
UNION ALL SELECT DISTINCT user_id, frame, 'strict' FROM k WHERE frame BETWEEN lo AND hi""")
def truth_keys(spark, sf):
    t = track(spark, sf, "event_type")
    live = t.withColumn("live", F.expr("event_type IN ('click', 'view') AND frame > 9"))
    keys = t.where("event_type = 'purchase'")
    both = [E.truth_keys(keys, live, ["user_id"], m).withColumn("mode", F.lit(m)) for m in ("clipped", "strict")]
    return both[0].unionByName(both[1])


@query("key_summary", f"""WITH {TOL1_SQL}
SELECT user_id % 10 AS element, CAST(sum(n_pred) AS BIGINT) AS keys_predicted, CAST(sum(n_truth) AS BIGINT) AS keys_artist,
  round(coalesce(sum(n_truth * precision) / nullif(sum(n_truth), 0), 0), 6) AS key_precision,
  round(coalesce(sum(n_truth * recall) / nullif(sum(n_truth), 0), 0), 6) AS key_recall,
  round(coalesce(sum(n_truth * f1) / nullif(sum(n_truth), 0), 0), 6) AS key_f1,
  round(sum(n_pred)::DOUBLE / greatest(1, sum(n_truth)), 6) AS key_ratio FROM s GROUP BY 1""")
def key_summary(spark, sf):
    _, pred, truth = sides(spark, sf)
    m = E.match_events(pred, truth, ["user_id"], 1).withColumn("element", F.expr("user_id % 10"))
    return rounded(E.key_summary(m, ["element"]))


@query("random_key_baseline", f"""WITH RECURSIVE {TRACK_SQL}, {greedy_sql('m', PRED_SQL, TRUE_SQL, 1, EITHER_SQL)},
{greedy_sql('r', drawn_sql("true", "SELECT user_id, count(*) AS n FROM m_p GROUP BY 1"), TRUE_SQL, 1, EITHER_SQL)}
SELECT {SCORED.replace("user_id", "m.user_id", 1).replace("n_pred", "m.n_pred", 1).replace("n_truth", "m.n_truth", 1).replace("(hits", "(m.hits").replace("round(", "round(m.")},
  round(r.f1, 6) AS baseline_f1, round(m.f1 - r.f1, 6) AS f1_over_random FROM m JOIN r USING (user_id)""")
def random_key_baseline(spark, sf):
    """As many frames drawn by hash as were chosen, scored beside them."""
    t, pred, truth = sides(spark, sf)
    return rounded(E.random_key_baseline(t.withColumn("live", F.lit(True)), pred, truth, ["user_id"], 1, 7))


LIVE_SQL = "SELECT DISTINCT user_id FROM track WHERE event_type <> 'error'"


@query("head_key_score", f"""WITH RECURSIVE {TRACK_SQL}, {greedy_sql('m', "SELECT user_id, frame FROM track WHERE event_type <> 'error' AND value / 100 > 0.5", TRUE_SQL, 1, LIVE_SQL)},
{greedy_sql('r', drawn_sql("event_type <> 'error'", "SELECT user_id, count(*) AS n FROM m_p GROUP BY 1"), TRUE_SQL, 1, LIVE_SQL)},
{greedy_sql('a', "SELECT user_id, frame FROM track WHERE event_type <> 'error'", TRUE_SQL, 1, LIVE_SQL)}
SELECT {SCORED.replace("user_id", "m.user_id", 1).replace("n_pred", "m.n_pred", 1).replace("n_truth", "m.n_truth", 1).replace("(hits", "(m.hits").replace("round(", "round(m.")},
  round(a.f1, 6) AS all_live_f1, round(r.f1, 6) AS random_f1, round(m.f1 - greatest(a.f1, r.f1), 6) AS over_best_baseline
FROM m JOIN r USING (user_id) JOIN a USING (user_id)""")
def head_key_score(spark, sf):
    """Head against the all-live and random baselines."""
    t = track(spark, sf, "event_type", "value").selectExpr(
        "user_id", "frame", "event_type", "event_type <> 'error' AS live", "value / 100 AS p")
    return rounded(E.head_key_score(t, t.where("event_type = 'purchase'"), ["user_id"], 0.5, 1, 7))


@query("all_live_baseline", f"""WITH {TRACK_SQL}, n AS (
  SELECT user_id, count(*) AS n_pred, count(*) FILTER (event_type = 'purchase') AS n_truth FROM track GROUP BY 1)
SELECT user_id, n_pred, n_truth, n_truth AS hits,
       round(CASE WHEN n_truth = 0 THEN 0 ELSE n_truth / n_pred END::DOUBLE, 6) AS precision, 1.0::DOUBLE AS recall,
       round(CASE WHEN n_truth = 0 THEN 0 ELSE 2 * n_truth / (n_pred + n_truth) END::DOUBLE, 6) AS f1 FROM n""")
def all_live_baseline(spark, sf):
    """Fire on every live frame: every truth key is an exact hit."""
    t, _, truth = sides(spark, sf)
    return rounded(E.match_events(t, truth, ["user_id"], 1))


@query("decode_count", """WITH l AS (
  SELECT label, i AS cls, sum(embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(64) r(i) GROUP BY ALL)
SELECT label, CAST(arg_max(cls, (v, -cls)) AS INTEGER) AS raw_count,
       CAST(least(greatest(arg_max(cls, (v, -cls)), 3), 48) AS INTEGER) AS count FROM l GROUP BY label""")
def decode_count(spark, sf):
    e = load(spark, sf, "embeddings").selectExpr("label", "transform(embedding, v -> CAST(v AS DOUBLE)) AS logits")
    return E.decode_count(e, ["label"], 48)


@query("count_report", """WITH c AS (
  SELECT label, vec_id, (SELECT arg_max(i, (embedding[i + 1], -i)) FROM range(64) r(i)) AS raw, 3 + vec_id % 40 AS truth
  FROM embeddings), d AS (SELECT label, least(greatest(raw, 3), 48) AS count, truth FROM c)
SELECT label, round(count(*) FILTER (count = truth)::DOUBLE / count(*), 6) AS point_count_exact,
  count(*) FILTER (count > truth) AS point_count_over, count(*) FILTER (count < truth) AS point_count_under
FROM d GROUP BY label""")
def count_report(spark, sf):
    e = load(spark, sf, "embeddings").selectExpr("label", "vec_id", "embedding AS logits")
    c = E.decode_count(e, ["label", "vec_id"], 48).withColumn("truth", F.expr("3 + vec_id % 40"))
    return rounded(E.count_report(c, "truth", ["label"]))


@query("slots_alive", """WITH s AS (
  SELECT label, i AS slot, bool_or(abs(embedding[i + 1]) > 0.3) AS alive FROM embeddings, range(64) r(i) GROUP BY ALL)
SELECT label, count(*) FILTER (alive) AS slots_alive FROM s GROUP BY label""")
def slots_alive(spark, sf):
    e = load(spark, sf, "embeddings").selectExpr("label", "posexplode(embedding) AS (slot, v)").selectExpr(
        "label", "slot", "abs(v) AS p")
    return E.slots_alive(e, ["label"], thresh=0.3)
