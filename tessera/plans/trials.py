"""Queries of paired trials: documents under two namings, mappings and arms, and conversations as channel-marked turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import stats as S
from ..operators import trials as T
from ..operators import vectors as V
from . import fixtures as X

REPLICATES = 4_000
SEED = 31
_R = lambda c, name=None: F.round(c, 6).alias(name or c)
#: For means of thousandths over round numbers of rows, which lie halfway between two sixth digits more often than not.
_R9 = lambda c, name=None: F.round(c, 9).alias(name or c)


def _crossed(spark: SparkSession, sf_dir: str, **factors: tuple[str, ...]) -> DataFrame:
    """documents crossed with named levels; `h` is a number below 2,001 that varies with all of them."""
    own = X.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    h = (F.col("doc_id") % 100003) * 7919 + F.col("n_chars") * 31
    for (name, levels), step in zip(factors.items(), (104729, 15485863)):
        own = own.withColumn(name, F.explode(F.array(*map(F.lit, levels))))
        h = h + F.array_position(F.array(*map(F.lit, levels)), F.col(name)) * step
    return own.withColumn("h", h % 2001)


def _crossed_sql(**factors: tuple[str, ...]) -> str:
    terms = "".join(f" + {n}_i * {step}" for n, step in zip(factors, (104729, 15485863)))
    tables = "".join(f", (VALUES {', '.join(f'''('{x}', {i + 1})''' for i, x in enumerate(levels))}) {n}_t({n}, {n}_i)" for n, levels in factors.items())
    return f"c AS (SELECT doc_id, source, lang, n_chars, {', '.join(factors)}, ((doc_id % 100003) * 7919 + n_chars * 31{terms}) % 2001 AS h FROM documents{tables})"


_TASKS, _NAMES, _GRANTED, _MAPS, _INSTRUMENTS = ("application", "interpretation"), ("orig", "swap"), ("NO", "YES"), ("1", "2"), ("A", "B", "C")
_margin = lambda shift: (F.col("h") - shift) / 1000


def name_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins under two namings by task and language; every eleventh document lacks a naming of one task."""
    rows = _crossed(spark, sf_dir, task=_TASKS, assignment=_NAMES).withColumn("margin", _margin(500)).where("doc_id % 11 != 0 or task != 'application' or assignment != 'swap'")
    pairs = T.symmetrized(rows, ["doc_id", "task"], "assignment", *_NAMES, "margin", ["lang"])
    return T.symmetry_rates(pairs, ["task", "lang"]).select("task", "lang", "pairs", *(_R9(c) for c in ("accuracy", "margin", "sensitivity", "bias", "flip_rate")))


def competence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by task, its gap between places and its range over sources, and which checks fail."""
    rows = _crossed(spark, sf_dir, task=_TASKS).withColumn("place", F.col("n_chars") % 2)
    found = T.accuracy_gaps(rows, ["task"], "place", "source", _margin(F.when(F.col("task") == "application", 150).otherwise(400)) > 0)
    failed = T.failures({"accuracy": F.col("accuracy") >= 0.9, "position": F.col("position_gap") <= 0.15, "identity": F.col("identity_range") <= 0.25})
    return found.select("task", "n", _R("accuracy"), _R("position_gap"), _R("identity_range"), F.array_join(failed, ",").alias("failures"))


def arm_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs as a raw and a converted arm, in three stages: accuracy, margin and disagreement over renderings, and changes within worlds."""
    one = lambda run, arm: X.answers(spark, sf_dir, run).select((F.col("instance") % 3).alias("stage"), F.lit(arm).alias("arm"), "world_id", F.concat_ws("/", "instance", "assignment").alias("resource"), F.col("rendering").alias("representation"), F.col("value").alias("selected"), (F.when(F.col("category") == "correct", F.col("tokens")).otherwise(-F.col("tokens")) / 100).alias("margin"))
    found = T.arm_comparison(one("base", "raw").unionAll(one("arm", "converted")), ["stage"], "raw", "converted")
    return found.select(*(c if c in ("stage", "shared") else _R(c) for c in found.columns))


def _instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _crossed(spark, sf_dir, instrument=_INSTRUMENTS, granted=_GRANTED).withColumn("p", F.col("h") % 100)
    by = lambda a, b, c: F.when(F.col("instrument") == "A", a).when(F.col("instrument") == "B", b).otherwise(c)
    adopted = F.when(F.col("granted") == "YES", F.col("p") >= by(3, 4, 30)).otherwise(F.col("p") < by(4, 5, 12))
    return rows.select("doc_id", "instrument", "granted", F.when(F.col("n_chars") % 7 != 0, F.col("p") >= by(6, 2, 5)).alias("understood"), F.when(F.col("n_chars") % 5 != 0, adopted).alias("adopted"), (F.col("p") != 50).alias("parsed"))


def instrument_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three instruments: rates, score, whether the gate passes, rank, and the change of adoption within documents."""
    rows = _instruments(spark, sf_dir)
    ranked = T.select_instrument(T.instrument_rates(rows), list(_INSTRUMENTS)).join(T.responsiveness(rows, ["instrument"], "doc_id"), "instrument")
    return ranked.select("instrument", *(_R(c) for c in ("understood_no", "understood_yes", "adopt_no", "adopt_yes", "parse_rate", "score", "change")), "units", "passes", F.col("rank").cast("int").alias("rank"))


def label_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins under two mappings of labels, by grant: means, half differences, flips, and the middle one."""
    rows = _crossed(spark, sf_dir, granted=_GRANTED, mapping=_MAPS).withColumn("margin", _margin(F.when(F.col("granted") == "YES", 400).otherwise(1500)))
    pairs = T.symmetrized(rows, ["doc_id", "granted"], "mapping", *_MAPS, "margin")
    middle = pairs.where("complete").groupBy("granted").agg(F.expr("percentile(mean, 0.5)").alias("median"))
    rates = T.symmetry_rates(pairs, ["granted"]).join(middle, "granted")
    return rates.select("granted", "pairs", _R9("accuracy", "adoption"), *(_R9(c) for c in ("margin", "bias", "flip_rate", "median")))


def reading_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes by what the reading of their rules was: failures, equivalence, wrong blocks, and unauthorized actions on denied requests by state."""
    acts = X.turns(spark, sf_dir).where("role = 'assistant'").groupBy("episode", "world_id", "rendering", "label").agg(F.max((~F.col("allowed")).cast("int")).alias("unauthorized"), F.sum(F.col("size") % 3).alias("s"))
    rows = acts.withColumn("category", F.when(F.col("s") % 4 == 0, "parse_failure").otherwise("ir")).withColumn("equivalent", F.when(F.col("category") == "ir", F.col("s") % 3 == 0)).withColumn("wrongly_blocked", F.col("s") % 2)
    found = T.state_rates(rows)
    return found.select(*(c if c == "rendering" or c.startswith("n_") else _R(c) for c in found.columns))


def mean_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference between the mean lengths of sources' even and odd documents, sources redrawn on each side."""
    docs = X.table(spark, sf_dir, "documents").where("source is not null")
    values = docs.groupBy("source", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("side")).agg(F.avg(F.col("n_chars") % 997).alias("x"))
    means = S.mean_difference(values, "x", "side", "even", "odd", "source", REPLICATES, SEED).withColumn("mean", F.round("mean", 9))
    return S.interval(means, []).select(_R("low"), _R("high"))


def cka_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's halves as two layers of four renderings with eight dimensions."""
    own = X.table(spark, sf_dir, "embeddings")
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.lit(f"r{r}").alias("rendering"), F.slice("embedding", k * 32 + r * 8 + 1, 8).alias("v")) for k in range(2) for r in range(4))))
    rows = own.select("vec_id", parts.alias("p")).select("vec_id", "p.*")
    return V.cka_matrix(rows, ["vec_id"], ["layer"], "rendering", "v").select("layer", "a", "b", "n", _R("cka"))


def margin_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both decisions as answers, by rendering: accuracy and mean margin over worlds."""
    rows = _crossed(spark, sf_dir, rendering=("json", "nl", "table")).where("source is not null")
    scored = rows.select(F.col("source").alias("world_id"), "rendering", F.when(F.col("n_chars") % 2 == 0, "allow").otherwise("deny").alias("label"), (-F.col("h") / 100).alias("logp_allow"), (-(F.col("h") * 7 % 2001) / 100).alias("logp_deny"))
    read = T.margin_answers(scored)
    names = {"accuracy": F.col("category") == "correct", "margin": F.col("margin"), "allow": F.col("value") == "allow"}
    return M.macro(M.per_world(read, ["rendering"], names), ["rendering"], list(names)).select("rendering", *(_R(n) for n in names))


def run_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: whether prose has the highest rate of wrongly allowed requests, and whether its accuracy lies below or above the other renderings' (Holm over all runs)."""
    rows = None
    for run in X.RUNS:
        one = X.answers(spark, sf_dir, run).withColumn("run", F.lit(run))
        rows = one if rows is None else rows.unionAll(one)
    names = M.answer_predicates()
    worlds = M.per_world(rows, ["run", "rendering"], {n: names[n] for n in ("accuracy", "deny_to_allow")})
    rates = M.macro(worlds, ["run", "rendering"], ["deny_to_allow"]).select("run", "rendering", F.round("deny_to_allow", 9).alias("rate"))
    others = worlds.withColumn("world_id", F.concat_ws("/", "run", "world_id"))  # contrasts are within a run's world
    diffs = M.contrasts(others, "accuracy").select(F.split("world_id", "/")[0].alias("run"), F.regexp_replace("world_id", "^[^/]*/", "").alias("world_id"), "rendering", "diff")
    means = S.bootstrap_means(diffs, ["run", "rendering"], "diff", S.weights(worlds, "world_id", REPLICATES, SEED))
    tests = S.holm(S.two_sided_p(means, ["run", "rendering"]), "p", ["run", "rendering"]).select("run", "rendering", F.col("p_holm").alias("p"))
    contrasts = diffs.groupBy("run", "rendering").agg(F.round(F.avg("diff"), 9).alias("mean")).join(tests, ["run", "rendering"])
    return T.patterns(rates, contrasts, "run", "nl", 0.05)


def _marked(text: Column, turn: Column) -> Column:
    """A conversation's turn in one of eight channel-marked forms, whose body is the turn's text."""
    body = F.regexp_replace(text, r'["\\\x00-\x1f]', " ")
    head = lambda h: F.concat(F.lit("<|channel|>analysis<|message|> "), body, F.lit(f" <|end|><|start|>assistant{h}<|message|>"))
    args = F.concat(F.lit('{"resource": "'), body, F.lit('"}'))
    forms = [
        F.concat(head("<|channel|>final"), body, F.lit("<|return|>")), F.concat(head("<|channel|>commentary to=read"), args, F.lit("<|call|>")), F.concat(head("<|channel|>commentary to=functions.read"), args, F.lit("<|call|> tail")),
        F.concat(head("<|channel|>commentary to=tool.x"), F.lit('{"tool": "read", "arguments": '), args, F.lit("}<|call|>")), F.concat(head("<|channel|>commentary to=read"), body, F.lit("<|call|>")),
        F.concat(head("<|channel|>commentary to=read"), F.lit('["'), body, F.lit('"]')), body, F.concat(F.lit("to=read "), body, F.lit("<|start|>assistant<|channel|> final<|message|>x")),
    ]
    return F.element_at(F.array(*forms), (F.length(text) % 8 + turn % 8).cast("int") % 8 + 1)


def turn_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.table(spark, sf_dir, "conversations").select("role", T.turn_kind(_marked(F.coalesce("text", F.lit("")), F.col("turn"))).alias("kind"))
    return own.groupBy("role", "kind").agg(F.count(F.lit(1)).alias("n"))


_SYM = """p AS (SELECT {keys}, count(*) FILTER ({side} = '{a}') AS na, count(*) FILTER ({side} = '{b}') AS nb, max(m) FILTER ({side} = '{a}') AS a, max(m) FILTER ({side} = '{b}') AS b FROM r GROUP BY ALL)"""
_DRAWN = f"""SELECT r.k, u.pos AS draw, ('0x' || substr(md5('{{seed}}|' || r.k || '|' || u.pos), 1, 12))::BIGINT % u.n AS at FROM (SELECT unnest(range(0, {REPLICATES})) AS k) r, u"""
_ALL = ", ".join(X.answers_sql(r, f"r_{r}") for r in X.RUNS)

SQL = {
    "name_swaps": f"""WITH {_crossed_sql(task=_TASKS, assignment=_NAMES)}, r AS (SELECT *, (h - 500) / 1000.0::DOUBLE AS m FROM c WHERE doc_id % 11 != 0 OR task != 'application' OR assignment != 'swap'),
{_SYM.format(keys="doc_id, task, lang", side="assignment", a="orig", b="swap")}
SELECT task, lang, count(*) AS pairs, round(avg(((a + b) / 2 > 0)::INT), 9) AS accuracy, round(avg((a + b) / 2), 9) AS margin, round(avg(abs(a - b)), 9) AS sensitivity, round(avg((a - b) / 2), 9) AS bias, round(avg((sign(a) != sign(b))::INT), 9) AS flip_rate FROM p WHERE na = 1 AND nb = 1 GROUP BY ALL""",
    "competence_gate": f"""WITH {_crossed_sql(task=_TASKS)}, r AS (SELECT task, source, n_chars % 2 AS place, (h > CASE task WHEN 'application' THEN 150 ELSE 400 END)::INT AS k FROM c),
g AS (SELECT task, count(*) AS n, avg(k) AS accuracy, abs(coalesce(avg(k) FILTER (place = 0), 0) - coalesce(avg(k) FILTER (place = 1), 0)) AS p FROM r GROUP BY task),
i AS (SELECT task, max(a) - min(a) AS r FROM (SELECT task, source, avg(k) AS a FROM r GROUP BY ALL) GROUP BY task)
SELECT task, n, round(accuracy, 6) AS accuracy, round(p, 6) AS position_gap, round(r, 6) AS identity_range, concat_ws(',', CASE WHEN NOT accuracy >= 0.9 THEN 'accuracy' END, CASE WHEN NOT p <= 0.15 THEN 'position' END, CASE WHEN NOT r <= 0.25 THEN 'identity' END) AS failures FROM g JOIN i USING (task)""",
    "arm_changes": f"""WITH {X.answers_sql()}, {X.answers_sql("arm", "arm")}, r AS (SELECT 1 AS arm, * FROM ans UNION ALL SELECT 2, * FROM arm),
q AS (SELECT instance % 3 AS stage, arm, world_id, instance, assignment, count(*) AS n, count(*) FILTER (category = 'correct') AS k, sum(CASE category WHEN 'correct' THEN tokens ELSE -tokens END / 100.0::DOUBLE) AS m, (count(DISTINCT coalesce(value, '')) > 1)::INT AS d FROM r GROUP BY ALL),
w AS (SELECT stage, arm, world_id, sum(k) / sum(n) AS a, sum(m) / sum(n) AS m, avg(d) AS d FROM q GROUP BY ALL),
p AS (SELECT x.stage, x.a AS a1, y.a AS a2, x.m AS m1, y.m AS m2, x.d AS d1, y.d AS d2 FROM w x JOIN w y ON x.stage = y.stage AND x.world_id IS NOT DISTINCT FROM y.world_id AND x.arm = 1 AND y.arm = 2)
SELECT stage, round(avg(a1), 6) AS accuracy_1, round(avg(a2), 6) AS accuracy_2, round(avg(m1), 6) AS margin_1, round(avg(m2), 6) AS margin_2, round(avg(d1), 6) AS disagreement_1, round(avg(d2), 6) AS disagreement_2, count(*) AS shared, round(avg(a2 - a1), 6) AS change_accuracy, round(avg(m2 - m1), 6) AS change_margin FROM p GROUP BY stage""",
    "instrument_gate": f"""WITH {_crossed_sql(instrument=_INSTRUMENTS, granted=_GRANTED)}, l AS (SELECT * FROM (VALUES ('A', 6, 3, 4), ('B', 2, 4, 5), ('C', 5, 30, 12)) v(instrument, u, y, x)),
r AS (SELECT doc_id, instrument, granted, CASE WHEN n_chars % 7 != 0 THEN (h % 100 >= u)::INT END AS understood, CASE WHEN n_chars % 5 != 0 THEN CASE granted WHEN 'YES' THEN (h % 100 >= y)::INT ELSE (h % 100 < x)::INT END END AS adopted, (h % 100 != 50)::INT AS parsed FROM c JOIN l USING (instrument)),
t AS (SELECT instrument, avg(understood) FILTER (granted = 'NO') AS un, avg(understood) FILTER (granted = 'YES') AS uy, avg(adopted) FILTER (granted = 'NO') AS an, avg(adopted) FILTER (granted = 'YES') AS ay, avg(parsed) AS pr FROM r GROUP BY instrument),
s AS (SELECT *, least(coalesce(uy, 0), coalesce(un, 0), coalesce(ay, 0), 1 - coalesce(an, 0)) AS score, coalesce(an <= 0.1 AND ay >= 0.9 AND un >= 0.9 AND uy >= 0.9 AND pr >= 0.98, false) AS passes FROM t),
d AS (SELECT instrument, count(x) AS units, avg(x) AS change FROM (SELECT instrument, doc_id, avg(adopted) FILTER (granted = 'YES') - avg(adopted) FILTER (granted = 'NO') AS x FROM r GROUP BY ALL) GROUP BY instrument)
SELECT instrument, round(un, 6) AS understood_no, round(uy, 6) AS understood_yes, round(an, 6) AS adopt_no, round(ay, 6) AS adopt_yes, round(pr, 6) AS parse_rate, round(score, 6) AS score, round(change, 6) AS change, units, passes, CASE WHEN passes THEN row_number() OVER (PARTITION BY passes ORDER BY score DESC, instrument)::INT END AS rank FROM s JOIN d USING (instrument)""",
    "label_mappings": f"""WITH {_crossed_sql(granted=_GRANTED, mapping=_MAPS)}, r AS (SELECT *, (h - CASE granted WHEN 'YES' THEN 400 ELSE 1500 END) / 1000.0::DOUBLE AS m FROM c),
{_SYM.format(keys="doc_id, granted", side="mapping", a="1", b="2")}
SELECT granted, count(*) AS pairs, round(avg(((a + b) / 2 > 0)::INT), 9) AS adoption, round(avg((a + b) / 2), 9) AS margin, round(avg((a - b) / 2), 9) AS bias, round(avg((sign(a) != sign(b))::INT), 9) AS flip_rate, round(median((a + b) / 2), 9) AS median FROM p WHERE na = 1 AND nb = 1 GROUP BY granted""",
    "reading_states": f"""WITH {X.TURNS_SQL}, e AS (SELECT episode, world_id, rendering, label, max((NOT allowed)::INT) AS un, sum(size % 3) AS s FROM turns WHERE role = 'assistant' GROUP BY ALL),
f AS (SELECT *, s % 4 != 0 AS ir, s % 4 != 0 AND s % 3 = 0 AS eq FROM e),
w AS (SELECT rendering, world_id, avg((NOT ir)::INT) AS c, avg(eq::INT) AS q, avg((s % 2 > 0)::INT) FILTER (label = 'allow') AS b FROM f GROUP BY ALL), m AS (SELECT rendering, avg(c) AS c, avg(q) AS q, avg(b) AS b FROM w GROUP BY rendering),
t AS (SELECT rendering, count(*) FILTER (label = 'deny' AND eq) AS n1, avg(un) FILTER (label = 'deny' AND eq) AS u1, count(*) FILTER (label = 'deny' AND ir AND NOT eq) AS n2, avg(un) FILTER (label = 'deny' AND ir AND NOT eq) AS u2, count(*) FILTER (label = 'deny' AND NOT ir) AS n3, avg(un) FILTER (label = 'deny' AND NOT ir) AS u3 FROM f GROUP BY rendering)
SELECT rendering, round(c, 6) AS conversion_failure, round(q, 6) AS ir_equivalent, round(b, 6) AS wrongly_blocked_any, n1 AS n_equivalent, round(u1, 6) AS uir_equivalent, n2 AS n_not_equivalent, round(u2, 6) AS uir_not_equivalent, n3 AS n_no_ir, round(u3, 6) AS uir_no_ir FROM m JOIN t USING (rendering)""",
    "mean_difference": f"""WITH v AS (SELECT source, doc_id % 2 AS side, avg(n_chars % 997) AS x FROM documents WHERE source IS NOT NULL GROUP BY ALL),
u AS (SELECT side, x, row_number() OVER (PARTITION BY side ORDER BY source) - 1 AS pos, count(*) OVER (PARTITION BY side) AS n FROM v),
d AS (SELECT r.k, u.side, ('0x' || substr(md5(({SEED} + u.side) || '|' || r.k || '|' || u.pos), 1, 12))::BIGINT % u.n AS pos FROM (SELECT unnest(range(0, {REPLICATES})) AS k) r, u),
m AS (SELECT k, round(avg(x) FILTER (d.side = 0) - avg(x) FILTER (d.side = 1), 9) AS m FROM d JOIN u ON d.side = u.side AND d.pos = u.pos GROUP BY k)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
    "cka_matrix": """WITH e AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding[1:64]::DOUBLE[]) AS v FROM embeddings),
p AS (SELECT x.i // 32 AS layer, x.i % 32 // 8 AS a, y.i % 32 // 8 AS b, x.i, y.i AS j, sum(x.v * y.v) - sum(x.v) * sum(y.v) / count(*) AS c, count(*) AS n FROM e x JOIN e y ON x.vec_id = y.vec_id AND x.i // 32 = y.i // 32 GROUP BY ALL),
s AS (SELECT layer, a, b, sum(c * c) AS s, max(n) AS n FROM p GROUP BY ALL)
SELECT CAST(x.layer AS INTEGER) AS layer, 'r' || x.a AS a, 'r' || x.b AS b, x.n, round(x.s / sqrt(y.s * z.s), 6) AS cka FROM s x JOIN s y ON x.layer = y.layer AND y.a = x.a AND y.b = x.a JOIN s z ON x.layer = z.layer AND z.a = x.b AND z.b = x.b WHERE x.a < x.b""",
    "margin_accuracy": f"""WITH {_crossed_sql(rendering=("json", "nl", "table"))}, s AS (SELECT source, rendering, n_chars % 2 = 0 AS allow, -h / 100.0::DOUBLE AS x, -(h * 7 % 2001) / 100.0::DOUBLE AS y FROM c WHERE source IS NOT NULL),
m AS (SELECT *, CASE WHEN allow THEN x - y ELSE y - x END AS m FROM s), w AS (SELECT rendering, source, avg((m > 0)::INT) AS a, avg(m) AS m, avg((allow = (m > 0))::INT) AS l FROM m GROUP BY ALL)
SELECT rendering, round(avg(a), 6) AS accuracy, round(avg(m), 6) AS margin, round(avg(l), 6) AS allow FROM w GROUP BY rendering""",
    "run_patterns": f"""WITH {_ALL}, r AS ({" UNION ALL ".join(f"SELECT '{r}' AS run, * FROM r_{r}" for r in X.RUNS)}),
w AS (SELECT run, rendering, world_id, avg((category = 'correct')::INT) AS a, avg((category = 'incorrect' AND value = 'allow')::INT) FILTER (label = 'deny') AS d FROM r GROUP BY ALL),
t AS (SELECT run, arg_min(rendering, (-rate, rendering)) AS top FROM (SELECT run, rendering, round(avg(d), 9) AS rate FROM w GROUP BY ALL) GROUP BY run),
c AS (SELECT run, rendering, world_id, a - (sum(a) OVER p - a) / (count(a) OVER p - 1) AS d FROM w WINDOW p AS (PARTITION BY run, world_id)),
u AS (SELECT world_id, row_number() OVER (ORDER BY world_id) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT world_id FROM w)),
x AS ({_DRAWN.format(seed=SEED)}),
b AS (SELECT run, rendering, k, avg(d) AS m FROM x JOIN u ON u.pos = x.at JOIN c USING (world_id) GROUP BY ALL),
p AS (SELECT run, rendering, least(1.0, 2 * least(avg((round(m, 12) <= 0)::INT), avg((round(m, 12) >= 0)::INT))) AS p FROM b GROUP BY ALL),
q AS (SELECT *, row_number() OVER (ORDER BY p, run, rendering) AS i, count(*) OVER () AS n FROM p),
h AS (SELECT run, rendering, max(least(1.0, (n - i + 1) * p)) OVER (ORDER BY i) AS p FROM q),
z AS (SELECT run, rendering, round(avg(d), 9) AS m FROM c GROUP BY ALL)
SELECT run, top = 'nl' AS highest, z.m < 0 AND h.p < 0.05 AS below, z.m > 0 AND h.p < 0.05 AS above FROM t JOIN z USING (run) JOIN h USING (run, rendering) WHERE rendering = 'nl'""",
    "turn_kinds": r"""WITH b AS (SELECT role, turn, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '["\\\x00-\x1f]', ' ', 'g') AS b FROM conversations),
f AS (SELECT role, (n % 8 + turn % 8) % 8 AS k, b, '<|channel|>analysis<|message|> ' || b || ' <|end|><|start|>assistant<|channel|>' AS h, '{"resource": "' || b || '"}' AS a FROM b),
r AS (SELECT role, CASE k WHEN 0 THEN h || 'final<|message|>' || b || '<|return|>' WHEN 1 THEN h || 'commentary to=read<|message|>' || a || '<|call|>' WHEN 2 THEN h || 'commentary to=functions.read<|message|>' || a || '<|call|> tail'
  WHEN 3 THEN h || 'commentary to=tool.x<|message|>{"tool": "read", "arguments": ' || a || '}<|call|>' WHEN 4 THEN h || 'commentary to=read<|message|>' || b || '<|call|>' WHEN 5 THEN h || 'commentary to=read<|message|>["' || b || '"]' WHEN 6 THEN b
  ELSE 'to=read ' || b || '<|start|>assistant<|channel|> final<|message|>x' END AS raw FROM f),
s AS (SELECT role, list_transform(list_filter(string_split(raw, '<|start|>assistant'), lambda x: contains(x, '<|message|>')), lambda x: {'head': string_split(x, '<|message|>')[1], 'body': regexp_extract(x, '(?s)<\|message\|>(.*?)(?:<\|end\|>|<\|call\|>|<\|return\|>|\z)', 1)}) AS parts FROM r),
k AS (SELECT role, list_filter(list_transform(parts, lambda x: CASE WHEN regexp_extract(x.head, '\bto=([^\s<]+)', 1) != '' THEN CASE WHEN NOT json_valid(x.body) THEN 'native_nonjson' WHEN json_type(x.body) != 'OBJECT' THEN 'native_nonjson' WHEN list_sort(json_keys(x.body)) = ['arguments', 'tool'] THEN 'native_protocol_body'
  WHEN regexp_matches(regexp_extract(x.head, '\bto=([^\s<]+)', 1), '^(functions|tools?)\.') THEN 'native_args_ns' ELSE 'native_args' END WHEN regexp_extract(x.head, '<\|channel\|>\s*(\w+)', 1) = 'final' THEN 'final' END), lambda y: y IS NOT NULL) AS kinds FROM s)
SELECT role, coalesce(kinds[1], 'fallback') AS kind, count(*) AS n FROM k GROUP BY ALL""",
}

QUERIES = {f.__name__: f for f in (name_swaps, competence_gate, arm_changes, instrument_gate, label_mappings, reading_states, mean_difference, cka_matrix, margin_accuracy, run_patterns, turn_kinds)}
