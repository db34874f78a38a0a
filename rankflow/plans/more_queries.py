"""Queries on scans and reports, normalisers, further temporal keys, counter tables, the final ranking and its choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankflow.functions import sql as S
from rankflow.functions import text as X
from rankflow.operators import features, history, metrics, ranking
from rankflow.operators import requests as R
from rankflow.plans import ranking_queries
from rankflow.plans.base import BOUNDARY, EXACT, IMP, PAST, REQUESTS, SCALE, STANDARD, TRUTH, Registry, candidates, clicks, contexts, for_requests, impressions, past, requests, truth, truth_of_contexts
from rankflow.plans.feature_queries import norm, tok
from rankflow.plans.history_queries import FAMILIES, NINE, WEEK_SQL, _asof_sql, counters, popular, recent, rounded
from rankflow.plans.ranking_queries import _GRID, MIDDLE, RRF, fused
from rankflow.sources import tables
from rankflow.sources.tables import table

registry = Registry()
add = registry.add


# Scans, sinks and SQL functions


@add(
    "SELECT 'nation.parquet' AS part, count(*) AS n, CAST(sum(n_regionkey) AS BIGINT) AS keys FROM nation UNION ALL SELECT 'region.parquet', count(*), NULL FROM region",
)
def multi_part_scan(spark, sf_dir):
    """Several files with different columns as one table, each row with its file."""
    rows = tables.parts(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"])
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_regionkey").cast("long").alias("keys"))


_STATEMENT = "SELECT o_custkey AS user, count(*) AS n, round(sum(o_totalprice), 2) AS value FROM {} WHERE o_orderstatus = 'F' GROUP BY o_custkey"


@add(_STATEMENT.format("orders"))
def sql_to_parquet(spark, sf_dir):
    """One statement, analysed, run, written and read again."""
    path = tables.shared_path(spark, "statement")
    tables.run_sql_to_parquet(spark, _STATEMENT.format(f"parquet.`{sf_dir}/orders.parquet`"), path)
    return spark.read.parquet(path)


@add(
    "SELECT p_partkey AS item, len({0}) AS tokens, CASE WHEN p_name = '' THEN 0 ELSE CAST({1} % 1000003 AS BIGINT) + 1 END AS bucket, {2} AS week FROM part".format(
        tok("p_name"),
        "('0x' || " + " || ".join(f"substr(sha1(p_name), {2 * k + 1}, 2)" for k in range(7, -1, -1)) + ")::UBIGINT",
        WEEK_SQL.replace("(t -", "(p_partkey * 86400 -"),
    )
)
def sql_functions(spark, sf_dir):
    """The library's helpers called from SQL text."""
    S.register(spark)
    return spark.sql(
        "SELECT p_partkey AS item, CAST(size(rankflow_tokens(p_name)) AS BIGINT) AS tokens, rankflow_bucket(p_name) AS bucket, rankflow_week_start(CAST(p_partkey * 86400 AS BIGINT)) AS week FROM {part}",
        part=table(spark, sf_dir, "part"),
    )


@add(IMP, f"SELECT CASE WHEN t < {BOUNDARY} THEN 'offline' ELSE 'full' END AS scope, count(*) AS n, CAST(sum(click) AS BIGINT) AS clicks FROM imp GROUP BY 1")
def scoped_counts(spark, sf_dir):
    """Counts of each scope, each read through a guard that ends the query on a row of the other."""
    rows = impressions(spark, sf_dir).withColumn("scope", F.when(F.col("t") < BOUNDARY, "offline").otherwise("full"))
    one = lambda s: tables.require_scope(rows.filter(F.col("scope") == s), s).agg(F.lit(s).alias("scope"), F.count(F.lit(1)).alias("n"), F.sum("click").alias("clicks"))
    return one("offline").unionByName(one("full"))


@add(
    IMP,
    "c AS (SELECT request, item, CASE WHEN line = 7 THEN NULL ELSE click * line END AS c FROM imp)",
    "SELECT request, count(*) FILTER (coalesce(c, 0) > 0) AS positive, count(*) FILTER (coalesce(c, 0) = 1) AS exactly_one FROM c GROUP BY request",
)
def click_predicates(spark, sf_dir):
    """Clicks by both predicates, which differ on numbers above 1."""
    count = F.when(F.col("line") != 7, F.col("click") * F.col("line"))
    return impressions(spark, sf_dir).groupBy("request").agg(F.count_if(R.clicked(count)).alias("positive"), F.count_if(R.clicked(count, exact=True)).alias("exactly_one"))


@add(
    IMP,
    "i AS (SELECT CASE WHEN line = 7 THEN NULL WHEN line = 6 THEN -item WHEN line = 5 AND grp % 2 = 0 THEN 0 ELSE item END AS item FROM imp)",
    "SELECT coalesce(item, 0) > 0 AS valid, count(*) AS n, count(DISTINCT item) FILTER (item > 0) AS items FROM i GROUP BY 1",
)
def item_prior_report(spark, sf_dir):
    """Rows with positive ids and their distinct ids, and how many rows have none."""
    item = F.when(F.col("line") == 7, None).when(F.col("line") == 6, -F.col("item")).when((F.col("line") == 5) & (F.col("grp") % 2 == 0), 0).otherwise(F.col("item"))
    counts = impressions(spark, sf_dir).select(item.alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    valid = F.coalesce(F.col("item"), F.lit(0)) > 0
    return counts.groupBy(valid.alias("valid")).agg(F.sum("n").alias("n"), F.count_if(valid).alias("items"))


# Texts. The other engine has no compatibility composition; the tables hold nothing that it would change but NFC.

_NFC = "nfc_normalize(text)"


@add("SELECT conv_id, turn, {0} AS normal, len({1}) AS words FROM conversations".format(norm(_NFC), "regexp_extract_all(lower(text), '[0-9a-zа-яё]+')"))
def composed_normal(spark, sf_dir):
    """Normal form after compatibility composition, and the words of the other tokenizer, which reads ё as it is."""
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.normalize(text, compose=True).alias("normal"), F.size(X.tokens(text, fold=False)).cast("long").alias("words"))


_SIX = {
    "raw": "coalesce(text, '')",
    "trim_lower": "lower(trim(coalesce(text, '')))",
    "nfkc": "lower(nfc_normalize(coalesce(text, '')))",
    "whitespace": "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))",
    "project": norm("nfc_normalize(coalesce(text, ''))"),
    "canonical": "array_to_string(list_sort({}), ' ')".format(tok("nfc_normalize(coalesce(text, ''))")),
}


@add(" UNION ALL ".join(f"SELECT '{n}' AS normalizer, count(*) AS n, count(DISTINCT {e}) AS texts, CAST(sum(length({e})) AS BIGINT) AS characters FROM conversations" for n, e in _SIX.items()))
def normalizer_audit(spark, sf_dir):
    """How many texts each of the six normalisers tells apart."""
    rows = table(spark, sf_dir, "conversations").select(*(c.alias(n) for n, c in X.normalizers(F.col("text")).items()))
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("normalizer"), F.col(n).alias("x")) for n in _SIX))).alias("e")).select("e.*")
    per_text = each.groupBy("normalizer", "x").agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("normalizer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.sum(F.length("x") * F.col("n")).alias("characters"))


# Temporal candidates by further keys

_PLACED = f"placed AS (SELECT DISTINCT request, key, region, t FROM imp WHERE click > 0 AND t >= {BOUNDARY})"


def _placed(spark, sf_dir):
    return clicks(spark, sf_dir).filter(F.col("t") >= BOUNDARY).select("request", "key", "region", "t").distinct()


def _by_place_sql(on: str, score: str, k: int, least: int, when: str = "AND e.t < q.t") -> tuple[str, ...]:
    return (
        IMP,
        _PLACED,
        "e AS (SELECT * FROM imp WHERE click > 0)",
        f"h AS (SELECT q.request, e.item, count(*) AS n, round(sum(e.cost), 6) AS value, max(e.t) AS last FROM placed q JOIN e ON {on} {when} GROUP BY ALL HAVING count(*) >= {least})",
        f"s AS (SELECT *, round({score}, 9) AS score FROM h)",
        f"SELECT request, item, n, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, n DESC, last DESC, item) AS rank FROM s) WHERE rank <= {k}",
    )


def _by_place(spark, sf_dir, parts, mode, k, least, timed=True):
    """Candidates of a key made of ``parts``; without ``timed`` the requests have no time and see all events."""
    key = F.concat_ws("|", *(F.col(p).cast("string") for p in parts)).alias("place")
    events = clicks(spark, sf_dir).select(key, "item", "t", "cost")
    asked = _placed(spark, sf_dir).select("request", key, F.col("t") if timed else F.lit(None).cast("long").alias("t"))
    return history.temporal_candidates(events, asked, "place", mode, k, least).select("request", "item", "n", "score", "rank")


@add(*_by_place_sql("q.region = e.region", "value * n / (n + 20::DOUBLE)", 10, 3))
def temporal_history_region(spark, sf_dir):
    return _by_place(spark, sf_dir, ["region"], "shrunk", 10, 3)


@add(*_by_place_sql("q.region = e.region AND q.key = e.key", "value * n / (n + 20::DOUBLE)", 20, 1))
def temporal_history_query_region(spark, sf_dir):
    return _by_place(spark, sf_dir, ["key", "region"], "shrunk", 20, 1)


@add(*_by_place_sql("q.region = e.region AND q.key = e.key", "CAST(last AS DOUBLE)", 20, 1))
def temporal_history_query_region_recent(spark, sf_dir):
    return _by_place(spark, sf_dir, ["key", "region"], "recency", 20, 1)


@add(*_by_place_sql("q.region = e.region AND q.key = e.key", "value / n", 20, 1))
def temporal_history_query_region_mean(spark, sf_dir):
    return _by_place(spark, sf_dir, ["key", "region"], "mean_value", 20, 1)


@add(*_by_place_sql("q.region = e.region AND q.key = e.key", "CAST(n AS DOUBLE)", 10, 1, ""))
def temporal_untimed(spark, sf_dir):
    """Requests without time, as in inference, see every event."""
    return _by_place(spark, sf_dir, ["key", "region"], "clicks", 10, 1, timed=False)


# Counters as model inputs

_WEEKS = {"d7": 7, "d28": 28, "all": 0}


def _inputs_sql() -> str:
    out = []
    for f in FAMILIES:
        for w in _WEEKS:
            of = lambda c: f"max(CASE WHEN family = '{f}' THEN {w}_{c} END)"  # noqa: B023, E731
            out += [
                f"round(ln(1 + {of('clicks')}), 6) AS {f}_{w}_log_clicks",
                f"round(ln(1 + greatest(0, {of('sum')})), 6) AS {f}_{w}_log_sum",
                f"round(max(CASE WHEN family = '{f}' THEN CASE WHEN {w}_clicks > 0 THEN {w}_sum / {w}_clicks ELSE 0 END END), 6) AS {f}_{w}_avg",
                f"round({of('age')}, 6) AS {f}_{w}_age",
                f"CAST({of('clicks')} > 0 AS INT) AS {f}_{w}_present",
            ]
    return ", ".join(out)


@add(*_asof_sql("t", f"t >= {BOUNDARY}", _WEEKS)[:-1], f"SELECT request, line, {_inputs_sql()} FROM w WHERE event = 0 GROUP BY request, line")
def counter_inputs(spark, sf_dir):
    """Ten key families by three windows by five inputs: 150 columns of each held-out line."""
    counted = counters(spark, sf_dir, _WEEKS).select("id.*", "*").drop("id")
    counted = counted.filter((F.col("all_clicks") > 0) | (F.col("family") == next(iter(FAMILIES))))  # a line's other families have zeros
    wide = features.counter_table(counted, ["request", "line"], list(FAMILIES), list(_WEEKS), zeros=True)
    digits = {"log_clicks": 6, "log_sum": 6, "avg": 6, "age": 6}
    return wide.withColumns({c: F.round(c, d) for c in wide.columns for n, d in digits.items() if c.endswith(f"_{n}")})


# The final ranking and the choices that lead to it

_BLENDED = """exact50 AS (SELECT request, item, rank_recent AS rank FROM req JOIN ranked USING (key) WHERE rank_recent <= 50),
keyed AS (SELECT e.*, least(coalesce(m.rank, 501), 501) AS model, count(*) OVER (PARTITION BY e.request) AS size FROM exact50 e LEFT JOIN rrf m ON e.request = m.request AND e.item = m.item),
blended AS (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY round(0.75::DOUBLE * rank / size + 0.25::DOUBLE * model / 501, 12), model, rank, item) AS rank FROM keyed),
popular AS (SELECT item, row_number() OVER (ORDER BY count(*) DESC, item) AS rank FROM past GROUP BY item),
joined AS (SELECT request, item, min(pos) AS pos FROM (
  SELECT request, item, rank AS pos FROM blended WHERE rank <= 20 UNION ALL SELECT request, item, 1000000 + rank FROM req, popular WHERE rank <= 70) GROUP BY ALL),
final AS (SELECT * FROM (SELECT request, item, row_number() OVER (PARTITION BY request ORDER BY pos, item) AS rank FROM joined) WHERE rank <= 50)"""


@add(IMP, PAST, TRUTH, REQUESTS, EXACT, NINE, *STANDARD[4:], RRF, _BLENDED, "SELECT request, item, rank FROM final")
def final_ranking(spark, sf_dir):
    """Exact lists in order of recency, blended with the fused ranks, first 20, then popular items up to 50."""
    everyone = contexts(spark, sf_dir).select(F.col("context").alias("request")).distinct()
    blended = ranking.exact_blend(recent(spark, sf_dir, 50), fused(spark, sf_dir).select("request", "item", "rank"), 0.25)
    first = blended.select("request", "item", F.col("new_rank").alias("rank"))
    return for_requests(spark, sf_dir, ranking.fill(first, popular(spark, sf_dir, everyone), 20, 50))


_EXPONENTS = (0.0, 0.3, 0.6)
_REFINED = f"""best AS (SELECT trial, a, b, c FROM grid ORDER BY early DESC, trial LIMIT 2),
wide AS (SELECT request, item, max(cost) AS cost, min(rank) FILTER (source = 'value') AS ra, min(rank) FILTER (source = 'count') AS rb, min(rank) FILTER (source = 'recency') AS rc FROM cand WHERE rank <= 20 GROUP BY ALL),
sc AS (SELECT trial, request, item, cost, round(CASE WHEN ra IS NULL THEN 0 ELSE a / (20::DOUBLE + ra) END + CASE WHEN rb IS NULL THEN 0 ELSE b / (20::DOUBLE + rb) END + CASE WHEN rc IS NULL THEN 0 ELSE c / (20::DOUBLE + rc) END, 12) AS s FROM wide, best),
rk AS (SELECT *, row_number() OVER (PARTITION BY trial, request ORDER BY s DESC, item) AS rank FROM sc WHERE s > 0),
ge AS (SELECT trial, x AS exponent, request, item, rank AS old, round(ln(rank) - x * ln(1 + greatest(0, cost) / {SCALE}::DOUBLE), 12) AS k, x FROM rk, (VALUES {', '.join(f'({x}::DOUBLE)' for x in _EXPONENTS)}) e(x)),
re AS (SELECT * FROM (SELECT trial, exponent, request, item, row_number() OVER (PARTITION BY trial, exponent, request ORDER BY CASE WHEN x = 0 THEN old ELSE k END, old, item) AS rank FROM ge) WHERE rank <= 10)"""


@add(
    *STANDARD,
    f"grid AS ({ranking_queries.registry.oracles['grid_tune']})",
    _REFINED,
    f"""SELECT CAST(trial AS BIGINT) AS trial, exponent, round(coalesce(sum(cost) FILTER (t.t < {MIDDLE}), 0) / (SELECT sum(cost) FROM truth WHERE t < {MIDDLE}), 9) AS early, round(sum(cost) / (SELECT sum(cost) FROM truth), 9) AS whole
FROM truth t JOIN re ON t.request = re.request AND t.item = re.item GROUP BY ALL""",
)
def grid_refine(spark, sf_dir):
    """The two best weight vectors of the early half, refined by the exponent of value."""
    best = ranking_queries.grid_tune(spark, sf_dir).orderBy(F.desc("early"), "trial").limit(2).select("trial", "a", "b", "c")
    near = candidates(spark, sf_dir).filter("rank <= 20")
    of = lambda s: F.min(F.when(F.col("source") == s, F.col("rank")))
    wide = near.groupBy("request", "item").agg(F.max("cost").alias("cost"), of("value").alias("ra"), of("count").alias("rb"), of("recency").alias("rc"))
    part = lambda w, r: F.when(F.col(r).isNull(), 0.0).otherwise(F.col(w) / (20.0 + F.col(r)))
    scored = wide.crossJoin(F.broadcast(best)).withColumn("s", F.round(part("a", "ra") + part("b", "rb") + part("c", "rc"), 12)).filter("s > 0")  # two rows
    ranked = ranking.numbered(scored, ["trial", "request"], [F.desc("s"), F.asc("item")]).withColumnRenamed("request", "_r")
    ranked = ranked.select(F.struct("trial", F.col("_r").alias("request")).alias("request"), "item", "cost", "rank")
    out = None
    for x in _EXPONENTS:
        one = ranking.value_geometry(ranked, x, SCALE, 1 << 30).filter("new_rank <= 10").select("request.trial", F.lit(x).alias("exponent"), "request.request", "item")
        out = one if out is None else out.unionByName(one)
    labels = truth_of_contexts(spark, sf_dir).select("request", "item", "t", "cost")
    early = F.when(F.col("t") < MIDDLE, F.col("cost"))
    totals = labels.agg(F.sum(early).alias("_e"), F.sum("cost").alias("_f"))
    sums = labels.join(out, ["request", "item"]).groupBy("trial", "exponent").agg(F.coalesce(F.sum(early), F.lit(0.0)).alias("e"), F.sum("cost").alias("f"))
    return sums.crossJoin(F.broadcast(totals)).select("trial", "exponent", F.round(F.col("e") / F.col("_e"), 9).alias("early"), F.round(F.col("f") / F.col("_f"), 9).alias("whole"))  # one row


_TRIALS = f"grid AS ({ranking_queries.registry.oracles['grid_tune']})"


@add(_TRIALS, "SELECT trial, early, late, \"full\", greatest(least(early, late), \"full\") AS robust FROM grid WHERE early >= 0 AND late >= 0 AND \"full\" >= 0 ORDER BY robust DESC, trial LIMIT 1")
def promotion_gate(spark, sf_dir):
    """The weight vector that is accepted: the most robust of those whose gains all reach the floor."""
    return metrics.promotion(ranking_queries.grid_tune(spark, sf_dir).select("trial", "early", "late", "full"), 0.0)


@add(_TRIALS, "SELECT trial, early, late, \"full\" FROM grid WHERE late >= (SELECT avg(late) FROM grid) - 1 ORDER BY \"full\" DESC, early DESC, trial = 3 DESC, trial LIMIT 1")
def best_trial(spark, sf_dir):
    """The first trial by two metrics among those that reach a floor; exact ties go to the preferred one."""
    trials = ranking_queries.grid_tune(spark, sf_dir).select("trial", "early", "late", "full")
    return metrics.best_trial(trials, "full", "early", floors={"late": -1.0}, prefer=3)


def _short_long_sql(name: str, ranks: str) -> str:
    return f"{name} AS (SELECT coalesce(sum(t.cost) FILTER (rank <= 10), 0) / sum(t.cost) AS short, coalesce(sum(t.cost) FILTER (rank <= 50), 0) / sum(t.cost) AS long FROM truth t LEFT JOIN ({ranks}) r ON t.request = r.request AND t.item = r.item)"


@add(
    *STANDARD,
    RRF,
    _short_long_sql("o", "SELECT * FROM cand WHERE source = 'value'"),
    _short_long_sql("n", "SELECT request, item, rank FROM rrf"),
    "SELECT n.short - o.short >= -1 AND o.long - n.long <= 1 AND n.short - o.short >= -0.5 AS accepted, round(n.short - o.short, 9) AS gain FROM o, n",
)
def retrieval_gate(spark, sf_dir):
    """Whether the fused ranking is accepted in place of one source, and its gain at the short cutoff."""
    labels = truth_of_contexts(spark, sf_dir).select("request", "item", "cost")

    def measures(ranks, name):
        found = metrics.recall(labels, ranks.select("request", "item", "rank"), (10, 50))
        at = lambda k: F.max(F.when(F.col("k") == k, F.col("cost_recall")))
        return found.agg(at(10).alias("short"), at(50).alias("long"))

    old = measures(candidates(spark, sf_dir).filter("source = 'value'"), "old")
    new = measures(fused(spark, sf_dir), "new")
    gate = metrics.retrieval_gate(old, new.withColumn("union", F.col("short")), -1.0, 1.0, -0.5)
    gain = old.select(F.col("short").alias("_s")).crossJoin(new).select(F.round(F.col("short") - F.col("_s"), 9).alias("gain"))
    return gate.crossJoin(gain)  # one row each


# The feature table


def _bucket_sql(x: str) -> str:
    digest = " || ".join(f"substr(sha1({x}), {2 * k + 1}, 2)" for k in range(7, -1, -1))
    return f"CASE WHEN {x} = '' THEN 0 ELSE CAST(('0x' || {digest})::UBIGINT % 1000003 AS BIGINT) + 1 END"


_CATALOG = """cat AS (SELECT p_partkey AS item, p_name AS title, p_type || ' ' || p_brand AS text, 'https://' || lower(p_type) || '.example/' || replace(p_name, ' ', '-') AS url, p_brand AS "group", CAST(p_size AS BIGINT) AS client,
  CASE WHEN p_size % 5 = 0 THEN '' ELSE lower(p_type) END AS domain, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice END AS price FROM part),
gst AS (SELECT "group", count(*) AS group_items, avg(coalesce(price, 0)) AS group_mean FROM cat GROUP BY 1), dst AS (SELECT domain, count(*) AS domain_items, avg(coalesce(price, 0)) AS domain_mean FROM cat GROUP BY 1)"""
_ASKED = """ask AS (SELECT request, key, lower(o_orderpriority || ' ' || c_mktsegment || ' widget') AS query, substr(o_orderpriority, 1, 1)::BIGINT AS place, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS region, CASE WHEN c_custkey % 11 > 0 THEN c_custkey END AS user,
  CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS device, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 90 END AS age, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS gender, CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 1000) END AS income
  FROM req JOIN orders ON request = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
_POOL = """hq AS (SELECT key, item, count(*) AS clicks, round(sum(cost), 2) AS value FROM past GROUP BY ALL), hr AS (SELECT DISTINCT region AS place, item FROM past),
fp AS (SELECT r.request, r.item, r.score, r.sources, r.cost, a.* EXCLUDE (request, key, place), c.* EXCLUDE (item), g.group_items, g.group_mean, d.domain_items, d.domain_mean, q.clicks, q.value, q.item IS NOT NULL AS in_query, h.item IS NOT NULL AS in_region
  FROM rrf r JOIN ask a ON r.request = a.request JOIN cat c ON r.item = c.item JOIN gst g ON c."group" = g."group" JOIN dst d ON c.domain = d.domain LEFT JOIN hq q ON a.key = q.key AND r.item = q.item LEFT JOIN hr h ON a.place = h.place AND r.item = h.item)"""


def _features_sql() -> dict[str, str]:
    flag = lambda e: f"CAST({e} AS DOUBLE)"
    toks = {c: f"list_distinct({tok(c)})" for c in ("query", "title", "text", "url")}
    norms = {c: norm(c) for c in toks}
    both = lambda a, b: f"len(list_intersect({a}, {b}))"
    jac = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN {both(a, b)} / len(list_distinct(list_concat({a}, {b})))::DOUBLE ELSE 0 END"
    log = lambda x: f"ln(1 + greatest(0, coalesce({x}, 0))::DOUBLE)"
    share = lambda x, p: f"CASE WHEN length({x}) > 0 THEN len(regexp_extract_all({x}, '{p}')) / length({x})::DOUBLE ELSE 0 END"
    out = {"fused_score": "score", "sources": "sources::DOUBLE"}
    out |= {f"{c}_chars": f"length({norms[c]})::DOUBLE" for c in ("query", "title", "text", "url")}
    out |= {f"{c}_tokens": f"len({toks[c]})::DOUBLE" for c in ("query", "title", "text", "url")}
    out |= {"title_overlap": both(toks["query"], toks["title"]) + "::DOUBLE", "text_overlap": both(toks["query"], toks["text"]) + "::DOUBLE"}
    out["any_overlap"] = both(toks["query"], f"list_distinct(list_concat({toks['title']}, {toks['text']}))") + "::DOUBLE"
    out |= {"title_jaccard": jac(toks["query"], toks["title"]), "text_jaccard": jac(toks["query"], toks["text"])}
    out["phrase_in_title"] = flag(f"length({norms['query']}) > 0 AND contains({norms['title']}, {norms['query']})")
    out |= {"log_cost": log("cost"), "log_history_clicks": log("clicks"), "log_history_value": log("value"), "in_query_history": flag("in_query"), "in_region_history": flag("in_region")}
    for name, step in (("region", 0), ("age", 10), ("gender", 0), ("income", 1), ("price", 0)):
        out |= {name: f"coalesce({name}, 0)::DOUBLE", f"{name}_missing": flag(f"{name} IS NULL")}
        if step:
            out[f"{name}_bucket"] = f"floor(coalesce({name}, 0)::DOUBLE / {step})"
    for name in ("device", "group", "client", "domain"):
        x = f"coalesce(CAST(\"{name}\" AS VARCHAR), '')"
        out |= {f"{name}_hash": f"({_bucket_sql(x)})::DOUBLE", f"{name}_missing": flag(f"{x} = ''")}
    out["user_present"] = flag('"user" IS NOT NULL')
    out |= {f"query_{n}": share(norms["query"], p) for n, p in (("digits", "[0-9]"), ("cyrillic", "[а-яё]"), ("latin", "[a-z]"))}
    out |= {"cost": "coalesce(cost, 0)", "cost_missing": flag("cost IS NULL"), "log_price": log("price")}
    out |= {f"{c}_digits": share(norms[c], "[0-9]") for c in ("url", "title", "text")} | {f"{c}_missing": flag(f"{norms[c]} = ''") for c in ("title", "text")}
    for n in ("group", "domain"):
        out |= {f"log_{n}_items": f"ln(1 + {n}_items::DOUBLE)", f"{n}_mean": f"{n}_mean", f"cost_to_{n}_mean": f"CASE WHEN abs({n}_mean) > 1e-12 THEN coalesce(cost, 0) / {n}_mean ELSE 0 END"}
    return out


_COLUMNS = _features_sql()


@add(*STANDARD, RRF, _CATALOG, _ASKED, _POOL, "SELECT request, item, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _COLUMNS.items()) + " FROM fp")
def feature_table(spark, sf_dir):
    """Base, request, income and static features of the fused pool, 59 columns under unique names."""
    small, missing = F.col("p_size"), F.lit(None)
    catalog = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"),
        F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(" "), "p_brand").alias("text"),
        F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("url"),
        F.col("p_brand").alias("group"),
        small.cast("long").alias("client"),
        F.when(small % 5 == 0, "").otherwise(F.lower("p_type")).alias("domain"),
        F.when(small % 7 == 0, missing).otherwise(F.col("p_retailprice")).alias("price"),
    )
    catalog = features.group_stats(features.group_stats(catalog, "group", "price"), "domain", "price")
    user, balance = F.col("c_custkey"), F.col("c_acctbal")
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == user).select(
        F.col("o_orderkey").alias("request"),
        F.lower(F.concat("o_orderpriority", F.lit(" "), "c_mktsegment", F.lit(" widget"))).alias("query"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("place"),
        F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("region"),
        F.when(user % 11 > 0, user).alias("user"),
        F.when(user % 5 > 0, F.col("c_mktsegment")).alias("device"),
        F.when(user % 7 > 0, user % 90).alias("age"),
        F.when(user % 3 > 0, user % 3).alias("gender"),
        F.when(balance >= 0, F.floor(balance / 1000)).alias("income"),
    )
    asked = requests(spark, sf_dir).select("request", "key").join(orders, "request").join(contexts(spark, sf_dir), "request")
    seen = past(spark, sf_dir)
    by_query = seen.groupBy("key", "item").agg(F.count(F.lit(1)).alias("clicks"), F.round(F.sum("cost"), 2).alias("value"), F.lit(True).alias("in_query"))
    by_region = seen.select(F.col("region").alias("place"), "item").distinct().withColumn("in_region", F.lit(True))
    query, title, text, url = (F.col(c) for c in ("query", "title", "text", "url"))
    of_request, of_pool = features.request_features(query), features.base_features(query, title, text) | features.static_features(url, title, text)
    features.check_names(["request", "item", *of_request, *of_pool])
    setting = F.struct("context", "key", "place", "query")  # all of a request that features of its pool depend on
    settings = asked.select(setting.alias("setting")).distinct().select("setting", "setting.*").withColumnRenamed("context", "request")
    pool = settings.join(fused(spark, sf_dir).select("request", "item", "score", "sources", "cost"), "request").join(catalog, "item").join(by_query, ["key", "item"], "left").join(by_region, ["place", "item"], "left")
    rounded_as = lambda found: (F.round(c, 6).alias(n) for n, c in found.items())
    pool = pool.select("setting", "item", *rounded_as(of_pool))
    asked = asked.select(setting.alias("setting"), "request", *rounded_as(of_request))
    return asked.join(pool, "setting").select("request", "item", *(n for n in _COLUMNS))
