"""Queries of segments, drift, baselines, thresholds, ensembles and importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessitura.operators import metrics, relations, segments, sequence
from tessitura.plans.model_queries import _P, _baskets, _ranked
from tessitura.plans.sequence_queries import _S, STREAM, sessions
from tessitura.session import materialize
from tessitura.tables import table

SEGMENTS = ["hour_bucket", "is_weekend", "session_phase", "repeat_from_prev", "skip_flag"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
MODELS = {"a": (1, 10), "b": (11, 10), "c": (21, 10)}
OPTIONS = {"a+b": {"a": 1.0, "b": 1.0}, "a+c": {"a": 1.0, "c": 1.0}, "b+c": {"b": 1.0, "c": 1.0}, "a+b+c": {"a": 2.0, "b": 1.0, "c": 1.0}}
RULE = "cast(l_quantity * 2 + l_discount * 100 - l_tax * 50 > 50 as int)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _frame(spark: SparkSession, folder: str) -> DataFrame:
    """Events with segments; the item before in the session stands as prediction, with less confidence the longer the session is."""
    h = sequence.session_so_far(sequence.calendar_parts(sessions(spark, folder, "offline", "platform"), "ts"), STREAM)
    before = F.coalesce(F.lag("artist").over(STREAM.over("session_id")), F.lit(""))
    rows = h.withColumns(segments.segment_columns("hour", "dow", "session_position", "repeats_previous", "skip") | {"before": before, "confidence": 1 / (F.col("session_position") + 2)})
    return rows.withColumn("correct", F.col("before") == F.col("artist"))


def m12_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(segments.segment_metrics(_frame(spark, folder), SEGMENTS, "correct", "confidence"))


def m12_regimes(spark: SparkSession, folder: str) -> DataFrame:
    rows = segments.with_regimes(materialize(_frame(spark, folder), "frame"), ["offline", "session_position"], "session_repeat_ratio", "platform")
    return _rounded(segments.segment_metrics(rows, ["friction_regime", "repeat_regime", "platform_bucket"], "correct", "confidence"))


def m12_errors(spark: SparkSession, folder: str) -> DataFrame:
    return segments.top_errors(_frame(spark, folder).where("before <> '' and artist <> ''").select("artist", "before"), "artist", "before")


def m9_report(spark: SparkSession, folder: str) -> DataFrame:
    report = segments.drift_report(table(spark, folder, "lineitem"), "l_linestatus", "O", "F", FEATURES)
    return _rounded(segments.low_drift(report, "shift", "distance"))


def m10_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of features of the history from its train to its test part, by family."""
    h = sequence.session_so_far(sequence.split_by_boundaries(sequence.calendar_parts(sessions(spark, folder, "offline"), "ts"), STREAM), STREAM)
    number = ["hour", "dow", "month", "session_position", "item_session_plays", "session_skip_rate", "session_repeat_ratio"]
    rows = h.select("split", *number, F.col("offline").cast("int").alias("offline"))
    return _rounded(segments.drift_groups(segments.drift_report(rows, "split", "train", "test", [*number, "offline"]), "feature", "shift"))


def m7_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(relations.quantiles(table(spark, folder, "orders"), "o_totalprice", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    h = sequence.split_by_boundaries(sessions(spark, folder).where("artist <> ''"), STREAM)
    w = STREAM.over("session_id")
    rows = h.withColumns({"before": F.lag("artist").over(w), "seen": F.collect_set("artist").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return materialize(rows.select("event_id", "split", "artist", "before", "seen"), "splits")


def m4_baselines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _splits(spark, folder)
    return _rounded(segments.next_item_baselines(rows.where("split = 'train'"), rows.where("split = 'validation'"), "before", "artist"))


def m3_policy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _splits(spark, folder)
    return _rounded(segments.policy_rewards(rows.where("split = 'train'"), rows.where("split = 'validation'"), "event_id", "before", "artist", "seen"))


def m13_guarded(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(metrics.guarded_temperature(_ranked(spark, folder), "proba", "label"))


def m15_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.abstention_threshold(_ranked(spark, folder), "vec_id", 0.05, target_risk=0.5)


def m15_threshold_by_trade(spark: SparkSession, folder: str) -> DataFrame:
    """With a risk that no share of the rows meets."""
    return metrics.abstention_threshold(_ranked(spark, folder), "vec_id", 0.05, target_risk=0.01, least_drop=0.0)


def m38_ensembles(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    rows = e.select(F.pmod("label", F.lit(10)).alias("label"), *(F.transform(metrics.softmax(F.slice("embedding", a, n)), lambda x: F.round(x, 12)).alias(m) for m, (a, n) in MODELS.items()))
    return metrics.ensemble_scores(rows, "label", OPTIONS)


def m39_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Of a fixed rule that foretells whether a line was returned."""
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_quantity", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return metrics.perturbation_importance(rows.groupBy("id").agg(*(F.max(c).alias(c) for c in rows.columns[1:])), "id", ["l_quantity", "l_discount", "l_tax"], RULE, "returned")


def m40_phases(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("seconds"))
    side = lambda s: o.where(F.col("o_orderstatus") == s).where(F.col("o_orderpriority").substr(1, 1) != ("1" if s == "F" else "5"))
    return _rounded(relations.phase_changes(side("O"), side("F"), "o_orderpriority", "seconds"))


def j15_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """Per nation, order priorities beside the most urgent one."""
    o = table(spark, folder, "orders").join(table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    per = o.groupBy("c_nationkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))
    return _rounded(relations.against_baseline(per, ["c_nationkey"], "o_orderpriority", "1-URGENT", ["n", "price"]))


def a47_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Of every artist of the vocabulary, also those without an event in the last part of the history."""
    h = sequence.split_by_boundaries(sequence.calendar_parts(sessions(spark, folder), "ts"), STREAM)
    labels = h.where("artist <> ''").select("artist").distinct()
    return _rounded(segments.labelled_profile(h.where("split = 'test' and artist <> ''"), labels, "artist", {"skip_rate": "skip", "avg_hour": "hour", "avg_session_position": "session_position"}))


def w11_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed share of the item's earlier events among all earlier events, in one order over all users."""
    rows = sequence.item_frequency(sessions(spark, folder).where("artist <> ''").select("event_id", "ts", "artist"), [F.col("ts"), F.col("event_id")], "artist")
    return rows.select("event_id", F.round("item_frequency", 12).alias("item_frequency"))


def w9_vocabulary_of_train(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the 50 most frequent artists of the first 64 % of the events, with the label of the artist."""
    h = sessions(spark, folder).where("artist <> ''").select("event_id", "ts", "artist")
    return sequence.with_vocabulary(h, [F.col("ts"), F.col("event_id")], "artist", 50, 0.64).select("event_id", "label")


def m21_m22_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Recall of candidates for the last part of every order, from neighbours counted without it; and their diagnostics."""
    from tessitura.operators import retrieval

    b = _baskets(spark, folder).distinct()
    last = b.groupBy("l_orderkey").agg(F.max("l_partkey").alias("l_partkey"), F.count(F.lit(1)).alias("n")).where("n > 1").select("l_orderkey", "l_partkey")
    rest = materialize(b.join(last, ["l_orderkey", "l_partkey"], "left_anti"), "rest")
    near = retrieval.item_neighbours(rest, "l_orderkey", "l_partkey", 5, 1.0)
    votes = rest.join(near, rest["l_partkey"] == near["item"]).groupBy("l_orderkey", F.col("neighbour").alias("l_partkey")).agg(F.round(F.sum("score"), 9).alias("score"))
    votes = votes.join(rest, ["l_orderkey", "l_partkey"], "left_anti")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("score"), "l_partkey")).cast("long")
    found = materialize(votes.withColumn("place", place).where("place <= 10"), "found")
    recall = retrieval.recall_at(found, last, "l_orderkey", "l_partkey", "place", [10]).select(F.col("recall").alias("recall_at_10"))
    return recall.join(retrieval.candidate_diagnostics(found, last, "l_orderkey", "l_partkey", rest.select("l_partkey").distinct()))


QUERIES = {
    f.__name__: f
    for f in (
        m12_segments, m12_regimes, m12_errors, m9_report, m10_groups, m7_quantiles, m4_baselines, m3_policy, m13_guarded, m15_threshold, m15_threshold_by_trade, m38_ensembles, m39_importance, m40_phases, j15_frontier, a47_profiles, w11_frequency, w9_vocabulary_of_train, m21_m22_holdout,
    )
}

_F = (
    _S
    + """, i AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_id, artist ORDER BY us, event_id) - 1 AS item_session_plays FROM s),
f0 AS (SELECT *, hour(ts) AS hour_, isodow(ts) - 1 AS dow_, month(ts) AS month_, coalesce(sum(skip::INT) OVER b, 0) AS k, coalesce(sum((item_session_plays = 0)::INT) OVER b, 0) AS u FROM i WINDOW b AS (PARTITION BY user_id, session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN session_position > 0 THEN k::DOUBLE / session_position ELSE 0 END AS skip_rate, CASE WHEN session_position > 0 THEN (session_position - u)::DOUBLE / session_position ELSE 0 END AS repeat_ratio, coalesce(prev, '') = artist AS correct, 1.0::DOUBLE / (session_position + 2) AS confidence,
  CASE WHEN hour_ >= 5 AND hour_ < 12 THEN 'morning' WHEN hour_ >= 12 AND hour_ < 17 THEN 'afternoon' WHEN hour_ >= 17 AND hour_ < 22 THEN 'evening' ELSE 'night' END AS hour_bucket, CASE WHEN dow_ >= 5 THEN 'weekend' ELSE 'weekday' END AS is_weekend, CASE WHEN session_position < 3 THEN 'early' WHEN session_position < 10 THEN 'mid' ELSE 'late' END AS session_phase,
  CASE WHEN prev = artist THEN 'repeat' ELSE 'new' END AS repeat_from_prev, CASE WHEN skip THEN 'skip' ELSE 'no_skip' END AS skip_flag FROM f0)
"""
)
_CUT = """, r0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS i_, count(*) OVER (PARTITION BY user_id) AS n_ FROM {0}),
c0 AS (SELECT user_id, n_, arg_min(i_, abs(i_ - n_ * 0.64::DOUBLE) + i_ * 1e-9::DOUBLE) FILTER (session_position = 0 AND i_ > 0) AS a_, arg_min(i_, abs(i_ - n_ * 0.8::DOUBLE) + i_ * 1e-9::DOUBLE) FILTER (session_position = 0 AND i_ > 0) AS b_ FROM r0 GROUP BY user_id, n_),
sp AS (SELECT r0.*, CASE WHEN i_ < coalesce(a_, r0.n_) THEN 'train' WHEN i_ < greatest(coalesce(a_, r0.n_), coalesce(b_, r0.n_)) THEN 'validation' ELSE 'test' END AS split FROM r0 JOIN c0 USING (user_id))
"""
_REPORT = """, st AS (SELECT feature, (avg(x) FILTER (b) - avg(x) FILTER (NOT b)) / CASE WHEN sqrt((var_pop(x) FILTER (b) + var_pop(x) FILTER (NOT b)) / 2) > 0 THEN sqrt((var_pop(x) FILTER (b) + var_pop(x) FILTER (NOT b)) / 2) ELSE 1 END AS shift, min(x) AS lo, max(x) AS hi, count(*) FILTER (b) AS nb, count(*) FILTER (NOT b) AS na FROM xs GROUP BY 1),
ce AS (SELECT xs.feature, least(coalesce(floor((x - lo) / nullif((hi - lo) / 20, 0)), 0), 19) AS bin, (count(*) FILTER (NOT b))::DOUBLE / max(na) AS p, (count(*) FILTER (b))::DOUBLE / max(nb) AS q FROM xs JOIN st USING (feature) GROUP BY 1, 2),
js AS (SELECT feature, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS distance FROM ce GROUP BY 1)
"""
_M4 = _S.rstrip() + ", w AS (SELECT * FROM s WHERE artist <> '')" + _CUT.format("w") + """, z AS (SELECT *, lag(artist) OVER (PARTITION BY user_id, session_id ORDER BY us, event_id) AS before FROM sp),
tr AS (SELECT * FROM z WHERE split = 'train'), te AS (SELECT * FROM z WHERE split = 'validation' AND before IS NOT NULL), n AS (SELECT artist, count(*) AS n FROM tr GROUP BY 1), fo AS (SELECT before, artist, count(*) AS c FROM tr WHERE before IS NOT NULL GROUP BY 1, 2)
"""
_TEMPS = ", ".join(f"({t}::DOUBLE)" for t in metrics.TEMPERATURES)


def _heat(t: str) -> str:
    z = "list_transform(p, lambda x: ln(least(greatest(x, 1e-9), 1.0)))"
    return f"list_transform({z}, lambda x: exp((x - list_max({z})) / {t}) / list_sum(list_transform({z}, lambda w: exp((w - list_max({z})) / {t}))))"


def _ece(name: str, proba: str) -> str:
    return f"{name}0 AS (SELECT y, {proba} AS v FROM r, be), {name}1 AS (SELECT least(floor(list_max(v) * 15), 14) AS b, count(*) AS n, avg((list_position(v, list_max(v)) - 1 = y)::INT) AS a, avg(list_max(v)) AS c FROM {name}0 GROUP BY 1), {name} AS (SELECT sum(n * abs(a - c)) / sum(n) AS e FROM {name}1)"


def _threshold(target: float, drop: float) -> str:
    return _P + f""", o AS (SELECT top, row_number() OVER w AS k, avg((rk <> 1)::INT) OVER (ORDER BY top DESC, vec_id ROWS UNBOUNDED PRECEDING) AS risk FROM r WINDOW w AS (ORDER BY top DESC, vec_id)), n AS (SELECT count(*) AS n, avg((rk <> 1)::INT) AS full_ FROM r),
e AS (SELECT *, k / n::DOUBLE AS share, full_ - risk AS gain, round(full_ - risk - 0.2 * (1 - k / n::DOUBLE), 12) AS u FROM o, n WHERE k / n::DOUBLE >= 0.1)
SELECT round(greatest(coalesce((SELECT top FROM e WHERE risk <= {target} ORDER BY k DESC LIMIT 1), (SELECT top FROM (SELECT * FROM e ORDER BY u DESC, k LIMIT 1) WHERE gain >= {drop}), 0.05), 0.05), 9) AS threshold"""


def _blend(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return "list_transform(" + list(weights)[0] + ", lambda x, i: round(" + " + ".join(f"{m}[i] * {w / total}::DOUBLE" for m, w in weights.items()) + ", 12))"


def _softmax(a: int, n: int) -> str:
    z = f"list_transform(embedding[{a}:{a + n - 1}], lambda x: x::DOUBLE)"
    return f"list_transform({z}, lambda x: round(exp(x - list_max({z})) / list_sum(list_transform({z}, lambda w: exp(w - list_max({z})))), 12))"


_SQL_RULE = RULE.replace("cast(", "CAST(").replace(" as int)", " AS INTEGER)")


def _importance() -> str:
    features = ["l_quantity", "l_discount", "l_tax"]
    sql = "WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max((l_returnflag = 'R')::INT) AS y FROM lineitem GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS at_, count(*) OVER () AS n FROM r), m AS (SELECT avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount, avg(l_tax) AS l_tax FROM r), "
    sql += f"b AS (SELECT avg(({_SQL_RULE} = y)::INT) AS base FROM r)"
    parts = []
    for f in features:
        others = [g for g in features if g != f]
        rule = _SQL_RULE
        for g in others:
            rule = rule.replace(g, f"n.{g}")
        ablated = rule.replace(f, f"m.{f}")
        drops = []
        for k in (1, 2, 3):
            sql += f", p_{f}_{k} AS (SELECT avg(({rule.replace(f, 'o.' + f)} = n.y)::INT) AS v FROM n JOIN n o ON (o.at_ + {k} * n.n // 4 + 1) % n.n = n.at_)"
            drops.append(f"(base - (SELECT v FROM p_{f}_{k}))")
        mean = "((" + " + ".join(drops) + ") / 3)"
        spread = "sqrt((" + " + ".join(f"({d} - {mean}) * ({d} - {mean})" for d in drops) + ") / 3)"
        parts.append(f"SELECT '{f}' AS feature, round({mean}, 9) AS permutation, round({spread}, 9) AS deviation, round(base - (SELECT avg(({ablated} = n.y)::INT) FROM n, m), 9) AS ablation FROM b")
    return sql + " " + " UNION ALL ".join(parts)


ORACLE = {
    "m12_segments": _F + " UNION ALL ".join(f"SELECT '{x}' AS segment, {x} AS bucket, count(*) AS count, round(avg(correct::INT), 9) AS top1, round(avg(confidence), 9) AS mean_confidence FROM f GROUP BY {x}" for x in SEGMENTS),
    "m12_regimes": _F
    + """, md AS (SELECT quantile_cont(coalesce(offline::INT, 0)::DOUBLE, 0.5) AS a, quantile_cont(session_position::DOUBLE, 0.5) AS b, quantile_cont(repeat_ratio, 0.5) AS c FROM f), g2 AS (SELECT *, greatest(coalesce(offline::INT, 0) - a, 0) + greatest(session_position - b, 0) AS score FROM f, md), hi AS (SELECT quantile_cont(score, 0.75) AS h FROM g2),
v AS (SELECT *, CASE WHEN score >= h THEN 'high_friction' ELSE 'normal_friction' END AS friction_regime, CASE WHEN repeat_ratio >= c THEN 'repeat_heavy' ELSE 'repeat_light' END AS repeat_regime, 'platform_' || coalesce(platform, '-1') AS platform_bucket FROM g2, hi)
"""
    + " UNION ALL ".join(f"SELECT '{x}' AS segment, {x} AS bucket, count(*) AS count, round(avg(correct::INT), 9) AS top1, round(avg(confidence), 9) AS mean_confidence FROM v GROUP BY {x}" for x in ("friction_regime", "repeat_regime", "platform_bucket")),
    "m12_errors": _F + "SELECT artist, prev AS before, count(*) AS count FROM f WHERE prev <> '' AND artist <> '' AND prev <> artist GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25",
    "m9_report": "WITH xs AS (" + " UNION ALL ".join(f"SELECT l_linestatus = 'F' AS b, '{c}' AS feature, {c}::DOUBLE AS x FROM lineitem WHERE l_linestatus IN ('O', 'F')" for c in FEATURES) + ")" + _REPORT + "SELECT feature, round(shift, 9) AS shift, round(distance, 9) AS distance, abs(shift) <= 0.2 AND distance <= 0.2 AS low_drift FROM st JOIN js USING (feature)",
    "m10_groups": _F
    + _CUT.format("f")
    + ", xs AS ("
    + " UNION ALL ".join(f"SELECT split = 'test' AS b, '{n}' AS feature, {c}::DOUBLE AS x FROM sp WHERE split IN ('train', 'test') AND {c} IS NOT NULL" for n, c in (("hour", "hour_"), ("dow", "dow_"), ("month", "month_"), ("session_position", "session_position"), ("item_session_plays", "item_session_plays"), ("session_skip_rate", "skip_rate"), ("session_repeat_ratio", "repeat_ratio"), ("offline", "offline::INT")))
    + ")"
    + _REPORT
    + """, fg AS (SELECT feature, abs(shift) AS a, CASE WHEN feature = 'offline' THEN 'technical' WHEN feature IN ('hour', 'dow', 'month', 'session_position') THEN 'temporal' ELSE 'behavioral' END AS feature_group FROM st)
SELECT feature_group, count(*) AS feature_count, round(avg(a), 9) AS mean_shift, round(max(a), 9) AS max_shift, arg_max(feature, a) AS top_feature FROM fg GROUP BY 1""",
    "m7_quantiles": "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 9) AS q{i}" for i, q in enumerate((0.0, 0.25, 0.5, 0.75, 0.9, 1.0))) + " FROM orders",
    "m4_baselines": _M4
    + """, b AS (SELECT before, artist AS nx FROM fo QUALIFY row_number() OVER (PARTITION BY before ORDER BY c DESC, artist) = 1)
SELECT count(*) AS rows, round(avg((te.artist = (SELECT artist FROM n ORDER BY n DESC, artist LIMIT 1))::INT), 9) AS majority_top1, round(avg((te.artist = te.before)::INT), 9) AS last_item_top1, round(avg((te.artist = coalesce(nx, (SELECT min(artist) FROM n)))::INT), 9) AS markov_top1 FROM te LEFT JOIN b USING (before)""",
    "m3_policy": _M4
    + """, ou AS (SELECT before, sum(c) AS o FROM fo GROUP BY 1), li AS (SELECT *, row_number() OVER (PARTITION BY before ORDER BY c DESC, artist) AS place FROM fo QUALIFY place <= 5), to_ AS (SELECT count(*) AS v, sum(n) AS t FROM n),
se AS (SELECT event_id, list(artist) OVER (PARTITION BY user_id, session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sp),
x AS (SELECT te.event_id, te.artist = li.artist AS hit, place, (0.65::DOUBLE * (c + 1) / (o + v) + 0.20::DOUBLE * list_contains(seen, li.artist)::INT + 0.15::DOUBLE * (1 - (n.n + 1)::DOUBLE / (t + v))) / (0.65::DOUBLE + 0.20::DOUBLE * len(list_distinct(seen)) + 0.15::DOUBLE * (v - 1)) AS u
  FROM te JOIN li USING (before) JOIN ou USING (before) JOIN n ON n.artist = li.artist JOIN se ON se.event_id = te.event_id, to_),
y AS (SELECT event_id, max(hit::INT) AS hit, sum(u / log2(place + 1)) AS reward, sum(u) AS mass FROM x GROUP BY 1) SELECT count(*) AS rows, round(avg(hit), 9) AS hit_at_k, round(avg(reward), 9) AS discounted_reward, round(avg(mass), 9) AS utility_mass FROM y""",
    "m13_guarded": _P
    + f""", tt AS (SELECT * FROM (VALUES {_TEMPS}) v(t)), nl AS (SELECT t, round(avg(-ln(greatest(({_heat("t")})[y + 1], 1e-12))), 12) AS l FROM r, tt GROUP BY t), be AS (SELECT t AS bt FROM nl ORDER BY l, t LIMIT 1), {_ece("ea", "p")}, {_ece("eb", _heat("bt"))}
SELECT bt AS candidate_temperature, round(ea.e, 9) AS raw_ece, round(eb.e, 9) AS calibrated_ece, eb.e <= ea.e + 1e-12 AS accepted, CASE WHEN eb.e <= ea.e + 1e-12 THEN bt ELSE 1 END AS temperature FROM be, ea, eb""",
    "m15_threshold": _threshold(0.5, 0.02),
    "m15_threshold_by_trade": _threshold(0.01, 0.0),
    "m38_ensembles": "WITH e AS (SELECT label % 10 AS y, " + ", ".join(f"{_softmax(a, n)} AS {m}" for m, (a, n) in MODELS.items()) + " FROM embeddings), x AS ("
    + " UNION ALL ".join(f"SELECT '{o}' AS option, y, {_blend(w)} AS p FROM e" for o, w in OPTIONS.items())
    + """), k AS (SELECT option, p[y + 1] AS own, 1 + len(list_filter(p, lambda v, i: v > p[y + 1] OR (v = p[y + 1] AND i - 1 < y))) AS rk FROM x),
g AS (SELECT option, round(avg((rk = 1)::INT), 9) AS top1, round(avg(CASE WHEN rk <= 5 THEN 1 / log2(rk + 1) ELSE 0 END), 9) AS ndcg, round(avg(-ln(greatest(own, 1e-12))), 9) AS nll FROM k GROUP BY 1)
SELECT *, option = (SELECT option FROM g ORDER BY top1 DESC, ndcg DESC, nll, option LIMIT 1) AS best FROM g""",
    "m39_importance": _importance(),
    "m40_phases": """WITH o AS (SELECT o_orderpriority, o_orderstatus AS s, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2), a AS (SELECT * FROM o WHERE s = 'O' AND o_orderpriority NOT LIKE '5%'), b AS (SELECT * FROM o WHERE s = 'F' AND o_orderpriority NOT LIKE '1%')
SELECT coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, CASE WHEN a.v IS NULL THEN 'missing' ELSE 'ok' END AS baseline_status, CASE WHEN b.v IS NULL THEN 'missing' ELSE 'ok' END AS candidate_status, coalesce(a.v, 0) AS baseline_seconds, coalesce(b.v, 0) AS candidate_seconds, round(coalesce(b.v, 0) - coalesce(a.v, 0), 9) AS delta_seconds,
  round((coalesce(b.v, 0) - coalesce(a.v, 0)) / nullif(coalesce(a.v, 0), 0), 9) AS delta_share, round(coalesce(a.v, 0) / nullif(coalesce(b.v, 0), 0), 9) AS speedup FROM a FULL JOIN b ON a.o_orderpriority = b.o_orderpriority""",
    "j15_frontier": """WITH p AS (SELECT c_nationkey, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)
SELECT p.*, p.n - b.n AS delta_n, round(p.price - b.price, 9) AS delta_price FROM p LEFT JOIN p b ON b.c_nationkey = p.c_nationkey AND b.o_orderpriority = '1-URGENT'""",
    "a47_profiles": _F
    + _CUT.format("f")
    + """SELECT artist, coalesce(n, 0) AS play_count, coalesce(a, 0) AS skip_rate, coalesce(b, 0) AS avg_hour, coalesce(c, 0) AS avg_session_position FROM (SELECT DISTINCT artist FROM f WHERE artist <> '') LEFT JOIN
(SELECT artist, count(*) AS n, round(avg(skip::INT), 9) AS a, round(avg(hour_), 9) AS b, round(avg(session_position), 9) AS c FROM sp WHERE split = 'test' GROUP BY 1) USING (artist)""",
    "w11_frequency": _S + "SELECT event_id, round((row_number() OVER (PARTITION BY artist ORDER BY us, event_id))::DOUBLE / (row_number() OVER (ORDER BY us, event_id) - 1 + (SELECT count(DISTINCT artist) FROM s WHERE artist <> '')), 12) AS item_frequency FROM s WHERE artist <> ''",
    "w9_vocabulary_of_train": _S
    + """, o AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS i, count(*) OVER () AS n FROM s WHERE artist <> ''), t AS (SELECT artist, count(*) AS c FROM o WHERE i < floor(n * 0.64::DOUBLE) GROUP BY 1 ORDER BY c DESC, artist LIMIT 50), l AS (SELECT artist, row_number() OVER (ORDER BY artist) - 1 AS label FROM t) SELECT event_id, label FROM o JOIN l USING (artist)""",
    "m21_m22_holdout": """WITH d AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS i FROM lineitem), la AS (SELECT s, max(i) AS i FROM d GROUP BY s HAVING count(*) > 1), b AS (SELECT * FROM d WHERE (s, i) NOT IN (SELECT s, i FROM la)),
n AS (SELECT i, count(*) AS n FROM b GROUP BY i), c AS (SELECT x.i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.s = y.s AND x.i <> y.i GROUP BY ALL),
k AS (SELECT c.i, c.j, round(c / (sqrt(a.n::DOUBLE * z.n) + 1), 9) AS sc FROM c JOIN n a ON a.i = c.i JOIN n z ON z.i = c.j QUALIFY row_number() OVER (PARTITION BY c.i ORDER BY round(c / (sqrt(a.n::DOUBLE * z.n) + 1), 9) DESC, c.j) <= 5),
v AS (SELECT b.s, k.j AS i, round(sum(sc), 9) AS sc FROM b JOIN k ON k.i = b.i GROUP BY ALL), u AS (SELECT * FROM v WHERE (s, i) NOT IN (SELECT s, i FROM b)), f AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sc DESC, i) AS place FROM u QUALIFY place <= 10),
q AS (SELECT la.s, count(f.i) AS n, max((f.i = la.i)::INT) AS hit FROM la LEFT JOIN f USING (s) GROUP BY la.s)
SELECT round(avg(coalesce(hit, 0)), 9) AS recall_at_10, count(*) AS queries, round(avg(n), 9) AS mean_candidates, min(n) AS least_candidates, max(n) AS most_candidates, round((SELECT count(DISTINCT i) FROM f)::DOUBLE / (SELECT count(DISTINCT i) FROM b), 9) AS catalogue_coverage FROM q""",
}
