"""Collocations by top-order marginalisation: only padded windows of the longest order are counted, and ROLLUP sums their prefixes.

Every word occurrence opens one window: itself and the words that follow it within its piece, `ORDER` at most, padded where the piece ends. A
phrase of k words occurs once in each window that begins with it, so f(phrase) is the sum of the window counts over everything after the
k-th word, which is what ROLLUP(lang, w1, .., wn) returns, for all orders at once and with the language's word count on top.

Words travel as 64-bit codes (the hash of their bytes), and a seed is searched for under which no two words of the table share one, so counts are exact;
their spelling comes back by a join for candidates alone. A window goes no further than a phrase can still be frequent: words and pairs
of neighbours, then three words whose pairs may be frequent, are counted into 2**`BITS` shared buckets first (fixed size, whatever the corpus), and a window
ends before a word whose own bucket, or that of the pair or three it would close, stays below the threshold. That never loses a phrase with f >= threshold; a fuller table of buckets only cuts less.

Defined cases: null texts are empty, a null lang counts as `und`; rows without a doc_id and repeated rows count like all others. An empty table
gives an empty result. Extra columns are ignored. Ties of score are settled by count and by the phrase's UTF-8 bytes, which are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

ORDER = 4
LEAST = 30
TOP = 2000
#: Buckets that words and pairs are counted into: 2 to this power, of which a bit each is broadcast (8 MB, twice).
BITS = 26
_SCALE = 2_000_000
_SPACE, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = _SPACE
_KIND[[*b".,;:!?", *range(10, 14)]] = _BREAK
_VOCABULARY = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
#: Buckets travel in blocks of 2 to this power, and are sent on when a task holds so many.
_BLOCK_BITS, _HELD_BUCKETS = 15, 4_000_000


def coded_words(data: np.ndarray, offsets: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, rows, whether the next word continues the piece, first bytes, end bytes) of the words of a chunk in lower case; codes are never 0."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none.astype(C.U64), none, none.astype(bool), none, none
    kind = _KIND[data]
    solid = kind == 0
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.r_[True, ~solid[:-1]] | edge[:n]))
    ends = np.flatnonzero(solid & (np.r_[~solid[1:], True] | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(kind == _BREAK)
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (rows[1:] == rows[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
    return C.span_codes(data, starts, ends, seed), rows, joined, starts, ends


def _chunks(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    for batch in batches:
        langs = batch.column(1).fill_null("und").to_numpy(zero_copy_only=False)
        for first, end, data, offsets in C.text_chunks(batch.column(0)):
            data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
            names, lang = np.unique(langs[first:end].astype(str), return_inverse=True)
            codes, rows, joined, starts, ends = coded_words(data, offsets, seed)
            yield data, names, lang[rows] if len(rows) else rows, codes, joined, starts, ends


def _buckets(codes: np.ndarray, lang: np.ndarray, names: np.ndarray, joined: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of the pairs that begin with each word (0 where none does)."""
    of_lang = np.array([int.from_bytes(x.encode()[:8], "little") for x in names], C.U64)[lang] if len(lang) else np.zeros(0, C.U64)
    own = C.mix64(codes ^ C.mix64(of_lang + C.U64(1)))
    pair = np.zeros(len(codes), C.U64)
    pair[:-1] = C.mix64(own[:-1] * C.U64(3) + codes[1:])
    shift = C.U64(64 - bits)
    return (own >> shift).astype(np.int64), np.where(joined, (pair >> shift).astype(np.int64), 0)


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, code, word, n) of all words of docs (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, names, lang, codes, _, starts, ends in _chunks(batches, seed):
            if not len(codes):
                continue
            order = np.lexsort((codes, lang))
            fresh = np.r_[True, (codes[order][1:] != codes[order][:-1]) | (lang[order][1:] != lang[order][:-1])]
            at = order[fresh]
            n = np.diff(np.r_[np.flatnonzero(fresh), len(order)])
            words = [bytes(data[a:b]).decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            yield C.batch_of(_VOCABULARY, [pa.array(names.tolist(), pa.string()).take(pa.array(lang[at].astype(np.int64))), codes[at].view(np.int64), words, n])

    return docs.mapInArrow(count, "lang string, code long, word string, n long").groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


def exact_vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """The vocabulary, written, and the seed that gave each of its words a code of its own."""
    seed = 0
    while True:
        found = C.written(vocabulary(docs, seed))
        if not found.groupBy("lang", "code").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
            return found, seed
        seed += 1


def _triples(codes: np.ndarray, lang: np.ndarray, names: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of the three words that begin with each word."""
    _, pair = _buckets(codes, lang, names, np.ones(len(codes), bool), 60)
    out = np.zeros(len(codes), C.U64)
    out[:-2] = C.mix64(pair[:-2].view(C.U64) * C.U64(5) + codes[2:])
    return (out >> C.U64(64 - bits)).astype(np.int64)


def _holds(flags: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (flags[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _frequent(codes: np.ndarray, lang: np.ndarray, names: np.ndarray, joined: np.ndarray, full: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word, and the pair that begins with it, may be frequent."""
    flags = np.frombuffer(full, np.uint8)
    own, pair = _buckets(codes, lang, names, joined, bits)
    often = _holds(flags, own)
    goes_on = joined & _holds(flags, pair)
    goes_on[:-1] &= often[:-1] & often[1:]
    return often, goes_on


def frequent_buckets(docs: DataFrame, seed: int, least: int, bits: int, pairs: bytes | None = None) -> bytes:
    """A bit for each bucket of words and pairs that counts to `least` or more; given these, for each bucket of three words of which both pairs may be frequent.

    Counts travel by blocks of buckets, as sorted places and counts up to `least`, and meet in dense arrays of one block.
    """
    schema = pa.schema([("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())])
    known = None if pairs is None else docs.sparkSession.sparkContext.broadcast(pairs)

    def blocks(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, n = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(bucket, kind="stable")
        bucket, n = bucket[order], n[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        n = np.minimum(np.add.reduceat(n, first), least).astype(np.uint16)
        bucket = bucket[first]
        block, place = bucket >> _BLOCK_BITS, (bucket & (1 << _BLOCK_BITS) - 1).astype(np.uint16)
        own, at = np.unique(block, return_index=True)
        parts = list(zip(at.tolist(), [*at[1:].tolist(), len(block)]))
        return C.batch_of(schema, [own.astype(np.int32), [place[a:b].tobytes() for a, b in parts], [n[a:b].tobytes() for a, b in parts]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for _, names, lang, codes, joined, _, _ in _chunks(batches, seed):
            if known is None:
                own, pair = _buckets(codes, lang, names, joined, bits)
                counted = np.r_[own, pair[joined]]
            else:
                _, goes_on = _frequent(codes, lang, names, joined, known.value, bits)
                counted = _triples(codes, lang, names, bits)[:-1][goes_on[:-1] & goes_on[1:]]
            found.append(np.unique(counted, return_counts=True))
            held += len(found[-1][0])
            if held > _HELD_BUCKETS:
                yield blocks(found)
                found, held = [], 0
        if held:
            yield blocks(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = counts.setdefault(block, np.zeros(1 << _BLOCK_BITS, np.uint16))
                at = np.frombuffer(places, np.uint16)
                own[at] = np.minimum(own[at].astype(np.uint32) + np.frombuffer(n, np.uint16), least)
        flags = [np.packbits(x >= least, bitorder="little").tobytes() for x in counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(flags, pa.binary())], names=["block", "flags"])

    if not 0 < least < 1 << 16:
        raise ValueError(f"a threshold of {least} is not within 1 to 65535")
    kinds = "block int, places binary, counts binary"
    merged = docs.mapInArrow(count, kinds).repartition(64, "block").mapInArrow(merge, "block int, flags binary")
    # 2**(bits - 15) rows of 4 KB at most.
    size = 1 << _BLOCK_BITS >> 3
    out = bytearray(max(1 << bits >> 3, size))
    for r in merged.collect():
        out[r["block"] * size : (r["block"] + 1) * size] = r["flags"]
    return bytes(out)


def windows(docs: DataFrame, seed: int, pairs: bytes, triples: bytes, bits: int, order: int) -> DataFrame:
    """(lang, w1 .. w{order}, n): each word's window, padded with 0 from where it ends."""
    held = docs.sparkSession.sparkContext.broadcast((pairs, triples))
    columns = [f"w{k}" for k in range(1, order + 1)]
    schema = pa.schema([("lang", pa.string()), *((c, pa.int64()) for c in columns), ("n", pa.int64())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, triples = held.value
        for _, names, lang, codes, joined, _, _ in _chunks(batches, seed):
            often, goes_on = _frequent(codes, lang, names, joined, pairs, bits)
            further = goes_on & _holds(np.frombuffer(triples, np.uint8), _triples(codes, lang, names, bits))
            further[:-1] &= goes_on[1:]
            codes = codes.view(np.int64)
            long = np.flatnonzero(goes_on)
            end = max(len(codes) - 1, 0)
            filled = [codes[long], codes[np.minimum(long + 1, end)]][:order]
            live = np.ones(len(long), bool)
            for k in range(2, order):
                live &= further[np.minimum(long + k - 2, end)]
                filled.append(np.where(live, codes[np.minimum(long + k, end)], 0))
            # Windows of one word, and those of words below the threshold, are summed here already.
            short = np.where(often, codes, 0)[~goes_on]
            spoken = lang[~goes_on]
            by = np.lexsort((short, spoken))
            fresh = np.r_[True, (short[by][1:] != short[by][:-1]) | (spoken[by][1:] != spoken[by][:-1])][: len(by)]
            at, n = by[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(by)])
            zeros = np.zeros(len(at), np.int64)
            own_names = pa.array(names.tolist(), pa.string()).take(pa.array(np.r_[lang[long], spoken[at]].astype(np.int64)))
            yield C.batch_of(schema, [own_names, np.r_[filled[0], short[at]], *(np.r_[x, zeros] for x in filled[1:]), np.r_[np.ones(len(long), np.int64), n]])

    kinds = ", ".join(f"{c} long" for c in columns)
    return docs.mapInArrow(of, f"lang string, {kinds}, n long").groupBy("lang", *columns).agg(F.sum("n").alias("n"))


def marginals(top: DataFrame, least: int, order: int) -> DataFrame:
    """(lang, words, f) of the phrases that occur `least` times or more, as arrays of codes; words is empty for a language as a whole. Written.

    Whole windows are counted already; what is shorter is their sums by ROLLUP over all columns but the last.
    """
    columns = [f"w{k}" for k in range(1, order + 1)]
    summed = top.rollup("lang", *columns[:-1]).agg(F.sum("n").alias("f"), F.grouping_id().alias("g"))
    size = order - 1 - F.bit_count("g").cast("int")
    shorter = summed.where((size == 0) | (size > 0) & (F.col("f") >= least)).select("lang", F.slice(F.array(*columns[:-1]), F.lit(1), F.greatest(size, F.lit(0))).alias("words"), "f")
    whole = top.where(F.col("n") >= least).select("lang", F.array(*columns).alias("words"), F.col("n").alias("f"))
    return C.written(shorter.unionAll(whole).where((F.size("words") == 0) | (F.element_at("words", -1) != 0)))


def _parts_found(asked: DataFrame, phrases: DataFrame) -> DataFrame:
    """asked (lang, words, ..) with f of words; where many ask for one word, the side that asks is split (adaptive execution), as each phrase stands once on the other."""
    return asked.join(phrases.select("lang", "words", "f"), ["lang", "words"])


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, order: int = ORDER, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `order` words by a / (f(first part) + f(rest)) at their worst cut."""
    texts = docs.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    words, seed = exact_vocabulary(texts)
    pairs = frequent_buckets(texts, seed, least, bits)
    triples = frequent_buckets(texts, seed, least, bits, pairs)
    phrases = marginals(windows(texts, seed, pairs, triples, bits, order), least, order)
    totals = phrases.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    candidates = phrases.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))

    cut = candidates.select("lang", F.col("words").alias("whole"), "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    shorter = phrases.where((F.size("words") > 0) & (F.size("words") < order))
    left = _parts_found(cut.select("*", F.slice("whole", F.lit(1), F.col("k")).alias("words")), shorter).withColumnRenamed("f", "l").drop("words")
    rest = F.slice("whole", F.col("k") + 1, F.size("whole") - F.col("k"))
    both = _parts_found(left.select("*", rest.alias("words")), shorter).withColumnRenamed("f", "r").drop("words")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    both = both.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {_SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    worst = both.groupBy("lang", F.col("whole").alias("words"), "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k))))
    covers = candidates.where(F.size("words") > 2).select("lang", F.col("a").alias("over"), F.explode(inner).alias("words")).groupBy("lang", "words").agg(F.max("over").alias("over"))
    open_ = worst.join(covers, ["lang", "words"], "left").where(F.isnull("over") | (wide("over") * 100 < wide("a") * 80))

    spelled = open_.select("lang", "words", "a", "m", F.posexplode("words").alias("at", "code"))
    known = words.where(F.col("n") >= least).select("lang", "code", "word")
    by_place = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = spelled.join(known, ["lang", "code"]).groupBy("lang", "words", "a", "m").agg(by_place.alias("phrase"))
    ranked = named.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # Within a part of a language first, so that no task ranks a whole language.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(256))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return last.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))
