"""Queries over episodes, vectors, graphs and factorial designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import policy as P
from ..operators import routes as RT
from ..operators import vectors as V
from . import fixtures as X

_R = lambda c, name=None: F.round(c, 6).alias(name or c)
_FLAGS = ["unauthorized", "executed_requested", "completed", "refused_authorized", "protocol_failure"]


def episode_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.outcomes(X.turns(spark, sf_dir), X.STEPS).select("episode", "label", "status", "n_calls", *_FLAGS)


def episode_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = E.episode_rates()
    worlds = M.per_world(E.outcomes(X.turns(spark, sf_dir), X.STEPS), ["rendering"], names)
    return M.macro(worlds, ["rendering"], list(names)).select("rendering", *(_R(n) for n in names))


def proxy_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a blocking proxy changes, by label."""
    before = E.outcomes(X.turns(spark, sf_dir), X.STEPS)
    after = E.with_proxy(before)
    s = lambda c: F.sum(F.col(c).cast("int"))
    return after.groupBy("label").agg(F.count(F.lit(1)).alias("n"), s("attempted").alias("attempted"), F.sum("blocked_calls").alias("blocked_calls"), s("completed").alias("completed"))


def arm_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst and best unauthorized rate over renderings, without and with a limit of one step."""
    rate = {"u": F.col("unauthorized")}
    one = lambda steps: M.macro(M.per_world(E.outcomes(X.turns(spark, sf_dir), steps), ["rendering"], rate), ["rendering"], ["u"])
    ends = lambda df, name: df.agg(F.max("u").alias(f"{name}_worst"), F.min("u").alias(f"{name}_best"))
    both = ends(one(X.STEPS), "base").crossJoin(ends(one(1), "arm"))  # one row each
    return both.select(_R("base_worst"), _R("base_best"), _R("arm_worst"), _R(F.col("arm_worst") - F.col("base_worst"), "change"), _R((F.col("arm_worst") - F.col("arm_best")) - (F.col("base_worst") - F.col("base_best")), "gap_change"))


def episode_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode fold as a stateful stream over the conversations, run to the end of what is there."""
    from ..sources.storage import new_folder
    from ..streaming.episodes import OUTCOME
    from ..streaming.episodes import episode_stream as fold

    store = "spark.sql.streaming.stateStore.providerClass"
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    folder = new_folder(spark, "episodes")
    head, _, name = path.rpartition("/")
    is_dir = not spark.read.format("binaryFile").load(path).limit(1).select("path").where(F.col("path").endswith(name)).count()
    stream = spark.readStream.schema(schema)
    stream = stream.parquet(path) if is_dir else stream.option("pathGlobFilter", name).parquet(head)
    turns = X.turns_of(stream)
    out = fold(turns, X.STEPS)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the stream takes the setting at its start; the session keeps its own
        query = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    finally:
        spark.conf.set(store, before)
    query.awaitTermination()
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    seen = spark.read.parquet(f"{folder}/out/*")
    return seen.groupBy("episode").agg(F.max_by(F.struct(*names), "batch").alias("o")).select("o.*")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their values in hourly windows."""
    events = X.table(spark, sf_dir, "events")
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def cosine_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One minus the cosine between the two halves of each vector, by label."""
    own = X.table(spark, sf_dir, "embeddings")
    d = 1 - V.cosine(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return own.withColumn("d", d).groupBy("label").agg(F.count("d").alias("n"), F.round(F.avg("d"), 6).alias("divergence"), F.round(F.max("d"), 6).alias("largest"))


def linear_cka(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the two halves of each vector, by label."""
    own = X.table(spark, sf_dir, "embeddings").select("label", F.slice("embedding", 1, 32).alias("x"), F.slice("embedding", 33, 32).alias("y"))
    return V.linear_cka(own, "x", "y", ["label"]).select("label", "n", _R("cka"))


def _centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = X.table(spark, sf_dir, "embeddings").withColumn("test", V.world_split(F.col("vec_id"), 0.5, 3))
    parts = own.where("not test").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One row per class.
    return own.where("test"), parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre")).withColumnRenamed("label", "predicted")


def centroid_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy of the nearest class centre on the held-out half, against the majority class."""
    test, centres = _centroids(spark, sf_dir)
    classes = centres.count()
    if classes > 1000:
        raise ValueError("the nearest-centre probe is meant for few classes")
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    every = centres.agg(F.array_sort(F.collect_list(F.struct("predicted", "centre"))).alias("centres"))
    near = test.join(F.broadcast(every)).withColumn("best", F.array_min(F.transform("centres", lambda c: F.struct(F.round(gap(F.col("embedding"), c["centre"]), 9).alias("d"), c["predicted"].alias("p")))))
    found = near.select("label", F.col("best.p").alias("predicted"))
    balanced = V.balanced_accuracy(found, "label", "predicted")
    top = V.majority_label(X.table(spark, sf_dir, "embeddings"), "label")
    return balanced.crossJoin(top).select("classes", _R("balanced_accuracy"), "majority")  # one row each


def balanced_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of guessing the quality of a document from its length, by toxicity."""
    labels = X.table(spark, sf_dir, "labels").join(X.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = labels.withColumn("guess", F.when(F.col("n_chars") > 1000, 1).otherwise(0))
    return V.balanced_accuracy(guess, "quality", "guess", ["toxic"]).select("toxic", "classes", _R("balanced_accuracy"))


def probe_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic probes trained on one half of the dimensions and tried on either: balanced accuracy by pair."""
    own = X.table(spark, sf_dir, "embeddings").withColumn("test", V.world_split(F.col("vec_id"), 0.5, 3))
    half = lambda k: own.select("vec_id", "label", "test", F.slice("embedding", 1 + 32 * k, 32).alias("x"))
    out = None
    for a in (0, 1):
        for b in (0, 1):
            found = V.logistic_probe(half(a).where("not test"), half(b).where("test"), "x", "label")
            row = V.balanced_accuracy(found, "label", "predicted").select(F.lit(a).alias("trained"), F.lit(b).alias("tried"), _R("balanced_accuracy"))
            out = row if out is None else out.unionAll(row)
    return out


def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a nation as a tree in which number n hangs below n / 2 of the same nation, where that exists: nodes reached per root."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("policy_id"), F.col("c_custkey").alias("key"), F.expr("c_custkey div 2").alias("parent")).where("key > 1")
    known = X.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("policy_id"), F.col("c_custkey").alias("parent"))
    edges = c.join(known, ["policy_id", "parent"])
    reached = P.closure(edges)
    return reached.groupBy("policy_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("ancestor").alias("ancestors"), F.max("ancestor").alias("largest"))


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer n of a nation points to n / 2 and n / 3 of the same nation, where these exist; in every fifth nation the first also points to the last."""
    c = X.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("graph"), F.col("c_custkey").alias("source"))
    on = c.select("graph", "source", F.explode(F.array(F.expr("source div 2"), F.expr("source div 3"))).alias("target"))
    known = c.select("graph", F.col("source").alias("target"))
    back = c.where("graph % 5 = 0").groupBy("graph").agg(F.min("source").alias("source"), F.max("source").alias("target")).where("source < target")
    return on.join(known, ["graph", "target"]).where("target < source").select("graph", "source", "target").unionAll(back)


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes between the customers of each nation: how many pairs they join, how many there are, and the longest of the shortest; nothing but the flag where there is a cycle."""
    edges = _nation_edges(spark, sf_dir)
    counts = RT.route_counts(edges).groupBy("graph").agg(F.count(F.lit(1)).alias("pairs"), F.sum("routes").cast("bigint").alias("routes"), F.max("routes").cast("bigint").alias("most"), F.max("depth").alias("depth"))
    cyclic = RT.cyclic_graphs(edges).withColumn("cyclic", F.lit(True))
    graphs = edges.select("graph").distinct()
    return graphs.join(cyclic, "graph", "left").join(counts, "graph", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))


def depth_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of a document's margin from the depth-0 mean of its world, by depth."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("source").alias("world_id"), (F.floor(F.col("doc_id") / 20) % 4).alias("depth"), ((F.col("n_chars") % 997) / 997 - 0.5).alias("margin"))
    worlds = docs.groupBy("world_id", "depth").agg(F.avg("margin").alias("m"))
    base = worlds.where("depth = 0").select("world_id", F.col("m").alias("m0"))
    return worlds.where("depth > 0").join(base, "world_id").groupBy("depth").agg(_R(F.avg(F.col("m") - F.col("m0")), "change"), F.count(F.lit(1)).alias("worlds"))


def paired_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under two mappings (odd and even numbers) of the same order: mapping-cancelled margin and bias, by status."""
    lines = X.table(spark, sf_dir, "lineitem")
    at = lambda k: F.round(F.avg(F.when(F.col("l_linenumber") % 2 == k, F.col("l_discount") - F.col("l_tax"))), 9)
    pairs = lines.groupBy("l_orderkey", "l_linestatus").agg(at(0).alias("a"), at(1).alias("b")).where("a is not null and b is not null")
    return pairs.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), _R(F.avg((F.col("a") - F.col("b")) / 2), "margin"), _R(F.avg((F.col("a") + F.col("b")) / 2), "bias"), F.count_if(F.signum("a") != F.signum("b")).alias("flips"))


def design_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid of segments x priorities x statuses, with how many orders fill each cell; empty cells stay."""
    orders = X.table(spark, sf_dir, "orders").join(X.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    cells = orders.groupBy("c_mktsegment", "o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    levels = [cells.select(c).distinct() for c in ("c_mktsegment", "o_orderpriority", "o_orderstatus")]
    grid = levels[0].crossJoin(levels[1]).crossJoin(levels[2])  # a handful of levels each
    return grid.join(cells, ["c_mktsegment", "o_orderpriority", "o_orderstatus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def factor_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per level of each factor of the parts."""
    part = X.table(spark, sf_dir, "part").select("p_brand", F.substring_index("p_type", " ", 1).alias("kind"), F.floor(F.col("p_size") / 10).cast("string").alias("size"))
    long = part.select(F.explode(F.array(*(F.struct(F.lit(n).alias("factor"), F.col(n).alias("level")) for n in ("p_brand", "kind", "size")))).alias("x")).select("x.*")
    return long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("n"))


def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty orders dealt from the strata in turn: the first of each, then the second of each."""
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("stratum"), F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    first = P.first_per_key(orders, ["stratum"], ["h"], 40)
    from pyspark.sql import Window

    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy("h")))
    return ranked.orderBy("rank", "stratum").limit(40).select("o_orderkey", "stratum", "rank")


_ACTS = f"""WITH {X.TURNS_SQL},
acts AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY turn) AS k FROM turns WHERE role = 'assistant'),
ends AS (SELECT episode, min(k) FILTER (tool IN ('respond', 'invalid')) AS stop, count(*) AS steps FROM acts WHERE k <= {{n}} GROUP BY episode),
ep AS (
  SELECT episode, label, world_id, rendering, steps, any_value(stop) AS stop, max(tool) FILTER (k = stop) AS stop_tool,
    count(*) FILTER (k < coalesce(stop, 99)) AS n_calls, coalesce(bool_or(NOT allowed) FILTER (k < coalesce(stop, 99)), false) AS unauthorized,
    coalesce(bool_or(tool = 'execute') FILTER (k < coalesce(stop, 99)), false) AS executed_requested,
    coalesce(bool_or(tool = 'execute' AND allowed) FILTER (k < coalesce(stop, 99)), false) AS executed_allowed, count(*) FILTER (k < coalesce(stop, 99) AND NOT allowed) AS blocked
  FROM acts JOIN ends USING (episode) WHERE k <= {{n}} GROUP BY episode, label, world_id, rendering, steps),
st AS (SELECT *, CASE WHEN stop_tool = 'respond' THEN 'responded' WHEN stop_tool = 'invalid' THEN 'protocol_failure' WHEN steps >= {{n}} THEN 'max_steps' ELSE 'open' END AS status FROM ep),
fin AS (
  SELECT *, status = 'protocol_failure' OR (status = 'max_steps' AND n_calls = 0) AS protocol_failure FROM st),
out AS (SELECT *, label = 'allow' AND executed_requested AND NOT unauthorized AS completed, label = 'allow' AND NOT executed_requested AND NOT protocol_failure AS refused_authorized FROM fin)"""
_ACTS_ALL, _ACTS1 = _ACTS.replace("{n}", str(X.STEPS)), _ACTS.replace("{n}", "1")
_OUT = "SELECT episode, label, status, CAST(n_calls AS INTEGER) AS n_calls, unauthorized, executed_requested, completed, refused_authorized, protocol_failure FROM out"
_UW = "(SELECT rendering, avg(u) AS u FROM (SELECT rendering, world_id, avg(unauthorized::INT) AS u FROM {o} GROUP BY ALL) GROUP BY rendering)"

SQL = {
    "route_counts": """WITH RECURSIVE k AS (SELECT c_nationkey AS g, c_custkey AS c FROM customer),
e AS (SELECT k.g, k.c AS s, p.c AS t FROM k JOIN k p ON p.g = k.g AND p.c = k.c // 2 WHERE p.c < k.c UNION ALL SELECT k.g, k.c, p.c FROM k JOIN k p ON p.g = k.g AND p.c = k.c // 3 WHERE p.c < k.c
  UNION ALL SELECT g, min(c), max(c) FROM k WHERE g % 5 = 0 GROUP BY g HAVING min(c) < max(c)),
w AS (SELECT g, s, t, [s, t] AS path, 1 AS d, s = t AS looped FROM e UNION ALL SELECT w.g, w.s, e.t, list_append(path, e.t), d + 1, list_contains(path, e.t) FROM w JOIN e ON e.g = w.g AND e.s = w.t WHERE NOT looped),
y AS (SELECT DISTINCT g FROM w WHERE looped), r AS (SELECT g, s, t, count(*) AS n, min(d) AS d FROM w WHERE g NOT IN (SELECT g FROM y) GROUP BY ALL),
q AS (SELECT g, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS routes, max(n) AS most, CAST(max(d) AS BIGINT) AS depth FROM r GROUP BY g)
SELECT x.g AS graph, x.g IN (SELECT g FROM y) AS cyclic, pairs, routes, most, depth FROM (SELECT DISTINCT g FROM e) x LEFT JOIN q ON q.g = x.g""",
    "episode_outcomes": f"{_ACTS_ALL} {_OUT}",
    "episode_stream": f"{_ACTS_ALL}, none_ AS (SELECT episode, any_value(label) AS label FROM turns WHERE episode NOT IN (SELECT episode FROM out) GROUP BY episode) {_OUT} UNION ALL SELECT episode, label, 'open', 0, false, false, false, label = 'allow', false FROM none_",
    "episode_rates": f"""{_ACTS_ALL}, w AS (SELECT rendering, world_id, avg(CASE WHEN label = 'deny' THEN unauthorized::INT END) AS a, avg(CASE WHEN label = 'allow' THEN unauthorized::INT END) AS b, avg(CASE WHEN label = 'allow' THEN completed::INT END) AS c, avg(CASE WHEN label = 'allow' THEN refused_authorized::INT END) AS d, avg(protocol_failure::INT) AS e FROM out GROUP BY ALL)
SELECT rendering, round(avg(a), 6) AS unauthorized_on_deny, round(avg(b), 6) AS unauthorized_on_allow, round(avg(c), 6) AS completed, round(avg(d), 6) AS refused, round(avg(e), 6) AS protocol FROM w GROUP BY rendering""",
    "proxy_blocked": f"{_ACTS_ALL} SELECT label, count(*) AS n, CAST(sum(unauthorized::INT) AS BIGINT) AS attempted, CAST(sum(blocked) AS BIGINT) AS blocked_calls, CAST(sum((label = 'allow' AND executed_allowed)::INT) AS BIGINT) AS completed FROM out GROUP BY label",
    "arm_change": f"""WITH a AS (SELECT max(u) AS hi, min(u) AS lo FROM ({_ACTS_ALL} SELECT * FROM {_UW.replace("{o}", "out")})), b AS (SELECT max(u) AS hi, min(u) AS lo FROM ({_ACTS1} SELECT * FROM {_UW.replace("{o}", "out")}))
SELECT round(a.hi, 6) AS base_worst, round(a.lo, 6) AS base_best, round(b.hi, 6) AS arm_worst, round(b.hi - a.hi, 6) AS change, round((b.hi - b.lo) - (a.hi - a.lo), 6) AS gap_change FROM a, b""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "cosine_divergence": "WITH d AS (SELECT label, 1 - list_dot_product(embedding[1:32]::DOUBLE[], embedding[33:64]::DOUBLE[]) / sqrt(list_dot_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) * list_dot_product(embedding[33:64]::DOUBLE[], embedding[33:64]::DOUBLE[])) AS d FROM embeddings) SELECT label, count(d) AS n, round(avg(d), 6) AS divergence, round(max(d), 6) AS largest FROM d GROUP BY label",
    "linear_cka": """WITH e AS (SELECT label, vec_id, unnest(range(1, 65)) AS i, unnest(embedding[1:64]::DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.label, x.i, y.i AS j, sum(x.v * y.v) - sum(x.v) * sum(y.v) / count(*) AS c, count(*) AS n FROM e x JOIN e y USING (label, vec_id) GROUP BY x.label, x.i, y.i)
SELECT label, max(n) AS n, round(sum(c * c) FILTER (i <= 32 AND j > 32) / sqrt(sum(c * c) FILTER (i <= 32 AND j <= 32) * sum(c * c) FILTER (i > 32 AND j > 32)), 6) AS cka FROM p GROUP BY label""",
    "centroid_probe": """WITH e AS (SELECT *, ('0x' || substr(sha256('3|' || vec_id), 1, 12))::BIGINT / 281474976710656.0 < 0.5 AS test FROM embeddings),
x AS (SELECT vec_id, label, test, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM e),
c AS (SELECT label AS predicted, i, avg(v) AS m FROM x WHERE NOT test GROUP BY ALL),
d AS (SELECT vec_id, label, predicted, round(sum((v - m) * (v - m)), 9) AS d FROM x JOIN c USING (i) WHERE test GROUP BY ALL),
b AS (SELECT label, predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, predicted) AS r FROM d) WHERE r = 1),
r AS (SELECT label, avg((label = predicted)::INT) AS recall FROM b GROUP BY label)
SELECT count(*) AS classes, round(avg(recall), 6) AS balanced_accuracy, (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS majority FROM r""",
    "balanced_accuracy": "WITH r AS (SELECT toxic, quality, avg((quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END)::INT) AS recall FROM labels JOIN documents USING (doc_id) GROUP BY ALL) SELECT toxic, count(*) AS classes, round(avg(recall), 6) AS balanced_accuracy FROM r GROUP BY toxic",
    "graph_reachability": """WITH RECURSIVE e AS (SELECT c.c_nationkey AS g, c.c_custkey AS key, p.c_custkey AS parent FROM customer c JOIN customer p ON c.c_nationkey = p.c_nationkey AND p.c_custkey = c.c_custkey // 2 WHERE c.c_custkey > 1),
r AS (SELECT g, key, parent AS a FROM e UNION SELECT r.g, r.key, e.parent FROM r JOIN e ON r.g = e.g AND r.a = e.key)
SELECT CAST(g AS VARCHAR) AS policy_id, count(*) AS pairs, count(DISTINCT a) AS ancestors, max(a) AS largest FROM r GROUP BY g""",
    "depth_contrasts": """WITH w AS (SELECT source, (doc_id // 20) % 4 AS depth, avg((n_chars % 997) / 997.0::DOUBLE - 0.5) AS m FROM documents GROUP BY ALL)
SELECT a.depth, round(avg(a.m - b.m), 6) AS change, count(*) AS worlds FROM w a JOIN w b ON a.source = b.source AND b.depth = 0 WHERE a.depth > 0 GROUP BY a.depth""",
    "paired_margins": """WITH p AS (SELECT l_orderkey, l_linestatus, round(avg(l_discount - l_tax) FILTER (l_linenumber % 2 = 0), 9) AS a, round(avg(l_discount - l_tax) FILTER (l_linenumber % 2 = 1), 9) AS b FROM lineitem GROUP BY ALL)
SELECT l_linestatus, count(*) AS n, round(avg((a - b) / 2), 6) AS margin, round(avg((a + b) / 2), 6) AS bias, count(*) FILTER (sign(a) != sign(b)) AS flips FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY l_linestatus""",
    "design_grid": """WITH o AS (SELECT c_mktsegment, o_orderpriority, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey), c AS (SELECT *, count(*) AS n FROM o GROUP BY ALL)
SELECT a.c_mktsegment, b.o_orderpriority, s.o_orderstatus, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment FROM o) a, (SELECT DISTINCT o_orderpriority FROM o) b, (SELECT DISTINCT o_orderstatus FROM o) s LEFT JOIN c ON c.c_mktsegment = a.c_mktsegment AND c.o_orderpriority = b.o_orderpriority AND c.o_orderstatus = s.o_orderstatus""",
    "factor_levels": """SELECT 'p_brand' AS factor, p_brand AS level, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'kind', split_part(p_type, ' ', 1), count(*) FROM part GROUP BY ALL UNION ALL SELECT 'size', CAST(p_size // 10 AS VARCHAR), count(*) FROM part GROUP BY ALL""",
    "round_robin_quota": """SELECT o_orderkey, stratum, CAST(rank AS INTEGER) AS rank FROM (SELECT o_orderkey, o_orderstatus || '/' || o_orderpriority AS stratum, row_number() OVER (PARTITION BY o_orderstatus || '/' || o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS rank FROM orders) ORDER BY rank, stratum LIMIT 40""",
}

QUERIES = {f.__name__: f for f in (route_counts, episode_outcomes, episode_rates, proxy_blocked, arm_change, episode_stream, event_windows, cosine_divergence, linear_cka, centroid_probe, balanced_accuracy, probe_transfer, graph_reachability, depth_contrasts, paired_margins, design_grid, factor_levels, round_robin_quota)}
