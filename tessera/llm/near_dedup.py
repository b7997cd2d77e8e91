"""Near-duplicate detection by BagMinHash: weighted-Jaccard signatures, banding, and verification of multiset overlap.

A document is the multiset of its five-word shingles. For its signature every shingle owns a Poisson process on weight x time,
laid over the dyadic weight intervals [0,1), [1,2), [2,4), ..; a point deals its time to one of `REGISTERS` registers
and counts for a document if its weight lies below the shingle's count there, which the position within the interval decides as the
repeated halving of that interval would. Register values are least times, so two documents agree in a register with probability of
their weighted Jaccard similarity. Only points before a time limit are made, about REGISTERS * log(REGISTERS) a document; where a
register stays empty the limit is doubled, so limits never change values.

Equal texts are one class member from the start. BANDS bands of ROWS registers miss a pair of similarity 0.8 with a probability of
about 2e-6. Buckets never emit all pairs: each member is first compared with a leader that it shares most
buckets with, verified pairs are joined to components, and then only members that a bucket still holds in different
components are compared, in pairs where they are few and otherwise by an inverted index over the whole bucket, which emits only links that join
components, so that no link between different texts is lost. Verification counts the shared shingles of the whole texts.

Defined cases: rows without text, or without any word, are classes of their own. A document of fewer than five words is one shingle. Rows without a
doc_id get no class and stay. Rows that repeat a doc_id share its class, which is that of their text of least hash. Extra columns are ignored by `near_classes` and kept by `keep_one`. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 100
ROWS = 4
BANDS = REGISTERS // ROWS
#: Members up to which what a bucket still holds apart is paired up; larger buckets are searched whole, block by block.
SMALL_BUCKET = 4
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1_000_000


def _shingles(texts: pa.Array, k: int = SHINGLE):
    """Per chunk: first row, end row, and (row, shingle, count) sorted by row and shingle."""
    for row, end, data, offsets in C.text_chunks(texts):
        codes, rows = C.word_hashes(data, offsets, lower=True)
        n = np.bincount(rows, minlength=end - row)
        starts = np.cumsum(n) - n
        grams = C.gram_hashes(codes, k)
        own = rows[: len(grams)] == rows[k - 1 :] if len(grams) else np.zeros(0, bool)
        r, h = rows[: len(grams)][own], grams[own]
        few = np.flatnonzero((n > 0) & (n < k))
        if len(few):
            short = np.array([np.bitwise_xor.reduce(C.mix64(codes[starts[i] : starts[i] + n[i]] + np.arange(n[i]).astype(C.U64))) for i in few], C.U64)
            r, h = np.r_[r, few], np.r_[h, short]
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])]) if len(r) else np.zeros(0, np.int64)
        yield row, end, r[first], h[first], np.diff(np.r_[first, len(r)])


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1)."""
    return ((x >> C.U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(n_rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Least times by row and register; inf throughout for rows without shingles."""
    total = np.bincount(row, weight, n_rows)
    sig = np.full((n_rows, registers), np.inf)
    limit = np.full(n_rows, registers * (math.log(registers) + 4.0)) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        own = todo[row]
        r0, h0, w0 = row[own], shingle[own], weight[own]
        levels = 1 + np.ceil(np.log2(np.maximum(w0, 1))).astype(np.int64)
        at = np.repeat(np.arange(len(r0)), levels)
        level = C.spread(levels)
        low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
        span = np.where(level == 0, 1.0, low)
        r, w = r0[at], w0[at].astype(np.float64)
        state = C.mix64(h0[at] + (level.astype(C.U64) + C.U64(1)) * C.U64(0xA0761D6478BD642F))
        t = np.zeros(len(r))
        flat = sig.reshape(-1)
        while len(r):
            state = state + C.U64(0x9E3779B97F4A7C15)
            t = t - np.log(_unit(C.mix64(state))) / span
            alive = t < limit[r]
            r, w, low, span, state, t = r[alive], w[alive], low[alive], span[alive], state[alive], t[alive]
            draw = C.mix64(state ^ C.U64(0xE7037ED1A0B428DB))
            # The high bits are the halvings of the weight interval, the rest choose the register.
            counts = low + span * _unit(draw) < w
            register = (C.mix64(draw) % C.U64(registers)).astype(np.int64)
            np.minimum.at(flat, r[counts] * registers + register[counts], t[counts])
        todo &= np.isinf(sig).any(axis=1)
        limit[todo] *= 2
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = sig.view(C.U64).reshape(len(sig), -1, rows)
    key = np.zeros(bits.shape[:2], C.U64)
    for j in range(rows):
        key = C.mix64(key * C.U64(0x9E3779B97F4A7C15 | 1) + bits[:, :, j])
    return key.view(np.int64)


def _banded(batches):
    for batch in batches:
        for row, end, r, h, w in _shingles(batch.column("text")):
            n = end - row
            total = np.bincount(r, w, n).astype(np.int64)
            keys = band_keys(signatures(n, r, h, w)) if len(r) else np.zeros((n, BANDS), np.int64)
            some = total > 0
            bands = pa.ListArray.from_arrays(np.cumsum(np.r_[0, np.where(some, BANDS, 0)]).astype(np.int32), pa.array(keys[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, n) for c in ("doc_id", "d1", "d2")), pa.array(total), bands], names=["doc_id", "d1", "d2", "n", "bands"])


def _bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingles, counts) of each text."""
    out = []
    for row, end, r, h, w in _shingles(texts):
        bounds = np.searchsorted(r, np.arange(end - row + 1))
        out += [(h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]]) for i in range(end - row)]
    return out


def _verified(similarity: float):
    """Rows of a group (leader, salt): first the leader's text (member null), then its members; emits linked pairs."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        leader, bag, size = None, None, 0
        for batch in batches:
            leaders, members = batch.column("leader").to_pylist(), batch.column("member").to_pylist()
            us, vs = [], []
            for u, v, own in zip(leaders, members, _bags(batch.column("text"))):
                if v is None:
                    leader, bag, size = u, own, int(own[1].sum())
                    continue
                if u != leader:
                    continue
                h, w = own
                at = np.minimum(np.searchsorted(bag[0], h), len(bag[0]) - 1)
                same = bag[0][at] == h
                shared = int(np.minimum(bag[1][at], w)[same].sum())
                if shared >= similarity * (size + int(w.sum()) - shared) - 1e-9:
                    us.append(u), vs.append(v)
            yield C.batch_of(schema, [us, vs])

    return run


def verify(pairs: DataFrame, texts: DataFrame, similarity: float, rows: int) -> DataFrame:
    """Of pairs (leader, member), about so many rows of them at most, those whose multiset overlap reaches the similarity. texts: (id, text).

    A leader's members are dealt to salted groups of about 64, each with one copy of the leader's text.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.ceil(F.col("of") / 64)).cast("int"))
    lead = pairs.select("leader", "salt").distinct().join(texts.withColumnRenamed("id", "leader"), "leader").select("leader", "salt", F.lit(None).cast("long").alias("member"), "text")
    rest = C.few(pairs.select("leader", "salt", "member"), rows).join(texts.withColumnRenamed("id", "member"), "member").select("leader", "salt", "member", "text")
    both = C.few(lead, rows).unionAll(C.few(rest, rows)).repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("member").asc_nulls_first())
    return both.mapInArrow(_verified(similarity), "u long, v long")


def bucket_links(bags: list, comps: list, similarity: float) -> list[tuple[int, int]]:
    """Places (i, j) of linked members in different components, no more of them than join the components up.

    Overlaps of a member with all later ones are summed over an inverted index of the shingles.
    """
    sizes = np.array([int(w.sum()) for _, w in bags])
    doc = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    shingle, weight = np.concatenate([h for h, _ in bags]), np.concatenate([w for _, w in bags])
    order = np.argsort(shingle, kind="stable")
    shingle, doc, weight = shingle[order], doc[order], weight[order]
    parent = {c: c for c in comps}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for i, (h, w) in enumerate(bags):
        lo, hi = np.searchsorted(shingle, h), np.searchsorted(shingle, h, "right")
        n = hi - lo
        at = np.repeat(lo, n) + C.spread(n)
        shared = np.bincount(doc[at], np.minimum(weight[at], np.repeat(w, n)), len(bags))
        near = np.flatnonzero(shared >= similarity * (sizes[i] + sizes - shared) - 1e-9)
        for j in near[near > i].tolist():
            a, b = root(comps[i]), root(comps[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _large_buckets(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) across components of buckets too large to pair up: whole blocks of members meet in a task, which emits joining links only.

    A bucket is one block while it holds at most BLOCK_MEMBERS members and BLOCK_SHINGLES shingles; beyond that it is dealt to
    blocks by hash, and each pair of blocks is a group.
    """
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_MEMBERS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = members.withColumn("g", blocks).withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("band", "h", F.least("b", "x").alias("p"), F.greatest("b", "x").alias("q"), "id", "comp").distinct()
    rows = dealt.join(texts, "id").repartition("band", "h", "p", "q").sortWithinPartitions("band", "h", "p", "q", "id").select("band", "h", "p", "q", "id", "comp", "text")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        key, ids, comps, bags = None, [], [], []

        def flush():
            links = bucket_links(bags, comps, similarity) if len(ids) > 1 else []
            return C.batch_of(schema, [[min(ids[i], ids[j]) for i, j in links], [max(ids[i], ids[j]) for i, j in links]])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("band", "h", "p", "q")))
            for k, i, c, bag in zip(keys, batch.column("id").to_pylist(), batch.column("comp").to_pylist(), _bags(batch.column("text"))):
                if k != key and ids:
                    yield flush()
                    ids, comps, bags = [], [], []
                key = k
                ids.append(i), comps.append(c), bags.append(bag)
        if ids:
            yield flush()

    return rows.mapInArrow(run, "u long, v long")


def _sized(pairs: DataFrame) -> DataFrame:
    """Add the number of members of each leader."""
    return pairs.join(pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("of")), "leader")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_shingles): one row per row of docs; class_id is the least doc_id of the class, n_shingles counts repeats."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = own.where("doc_id is not null").withColumn("d1", F.xxhash64(F.lit(1), "text")).withColumn("d2", F.xxhash64(F.lit(2), "text"))
    banded = C.checkpoint(keyed.mapInArrow(_banded, "doc_id long, d1 long, d2 long, n long, bands array<long>"))
    rows = banded.count()
    own_text = banded.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("k")).select(F.col("doc_id").alias("id"), "k.d1", "k.d2")
    # One member for each different text; wordless rows stay apart.
    standing = C.few(banded.join(own_text.withColumnRenamed("id", "doc_id"), ["doc_id", "d1", "d2"]), rows)
    distinct = standing.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "bands")).alias("x")).select("d1", "d2", "x.*")
    distinct = C.few(distinct.withColumnRenamed("doc_id", "id"), rows)
    members = distinct.select("id", "n", F.posexplode("bands").alias("band", "h"))
    held = members.groupBy("band", "h").agg(F.min(F.struct(F.xxhash64("id", "band").alias("z"), "id", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("band", "h", "lead")
    buckets = members.join(held, ["band", "h"]).select("band", "h", "id", "n", F.col("lead.id").alias("leader"), F.col("lead.n").alias("leader_n"))
    buckets = C.checkpoint(C.few(buckets, rows * BANDS))
    held_rows = buckets.count()
    fits = f"least(n, leader_n) >= {similarity} * greatest(n, leader_n) - 1e-9"
    stars = buckets.where("id != leader").where(fits).groupBy("id", "leader").agg(F.count(F.lit(1)).alias("shared"))
    stars = C.few(stars, held_rows)
    best = stars.groupBy("id").agg(F.max(F.struct("shared", F.xxhash64("leader").alias("z"), "leader")).alias("best")).select(F.col("best.leader").alias("leader"), F.col("id").alias("member"))
    best = C.few(best, rows)
    wanted = C.few(buckets.select("id").distinct().join(distinct.select("id", "d1", "d2"), "id").select(F.col("id").alias("doc_id"), "d1", "d2"), rows)
    texts = keyed.join(wanted, ["doc_id", "d1", "d2"], "left_semi").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    # Both verifications read them: written once, or all texts would be shuffled for each.
    texts = C.checkpoint(C.few(texts, rows))
    first = C.checkpoint(verify(_sized(best), texts, similarity, rows))
    comps = components(first)
    # What a bucket still holds in different components is compared across them; its largest component is never paired with itself.
    placed = buckets.join(comps, buckets["id"] == comps["node"], "left").select("band", "h", "id", "n", F.coalesce("component", "id").alias("comp"))
    placed = C.checkpoint(C.few(placed, held_rows))
    mixed = placed.groupBy("band", "h").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a != b").select("band", "h")
    open_ = placed.join(mixed, ["band", "h"])
    sizes = open_.groupBy("band", "h").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    open_ = open_.join(sizes, ["band", "h"])
    few = open_.where(F.col("members") <= SMALL_BUCKET)
    some = few.select("band", "h", F.col("id").alias("leader"), F.col("n").alias("leader_n"), F.col("comp").alias("leader_comp"))
    across = some.join(few, ["band", "h"]).where("comp > leader_comp").where(fits)
    pairs = across.select(F.least("id", "leader").alias("leader"), F.greatest("id", "leader").alias("member"))
    pairs = C.few(C.few(pairs, 2 * held_rows).distinct(), 2 * held_rows)
    tried = best.select(F.least("leader", "member").alias("leader"), F.greatest("leader", "member").alias("member"))
    left = C.few(pairs.join(tried, ["leader", "member"], "left_anti"), 2 * held_rows)
    second = verify(_sized(left), texts, similarity, 2 * held_rows)
    second = second.unionAll(_large_buckets(open_.where(F.col("members") > SMALL_BUCKET), texts, similarity))
    second = C.checkpoint(second)
    ends = components(first.unionAll(second)) if not second.isEmpty() else comps
    of_text = C.few(distinct.select("d1", "d2", "id").join(ends, distinct["id"] == ends["node"], "left").select("d1", "d2", F.coalesce("component", "id").alias("class_id")), rows)
    of_doc = C.few(own_text, rows).join(of_text, ["d1", "d2"], "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"))
    of_doc = C.few(of_doc, rows)
    classed = banded.select("doc_id", "n").join(of_doc, "doc_id").select("doc_id", "class_id", "n")
    nameless = own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("n"))
    return C.few(classed, rows).unionAll(nameless).withColumnRenamed("n", "n_shingles")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; rows without a doc_id stay."""
    away = near_classes(docs, similarity).where("class_id != doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(away, docs["doc_id"].cast("long") == away["_gone"], "left_anti")


def op9_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(C.table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
