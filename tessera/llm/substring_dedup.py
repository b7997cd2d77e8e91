"""Substring dedup: repeated word sequences found in prefix-partitioned suffix trees.

Every window of `min_words` words holds a *sample point*: the smallest-hashed run of ANCHOR words in it. Equal
windows have equal sample points, so suffix trees over the suffixes at sample points (with the words that lead up
to them) hold every repeat of `min_words` or more. The suffixes are split into groups by a prefix of variable length: ANCHOR words first, and where more than
`group_segments` suffixes share a prefix, those are sampled anew with PREFIX_STEP words more, until a group fits or the prefix would be a whole window.

* A group that fits goes to one task, with the stretches of text whose windows belong to it. The task builds the subtree as suffix array and
  longest common prefixes (ranks of 1, 2, 4 .. words by doubling until all are unique, then common lengths by halving). Intervals of
  the array with a common prefix of `min_words` or more are the internal nodes that deep; of the leaves under one, all but the earliest, its leader, are
  later copies. Neighbouring leaves of one document whose leaders are neighbours too continue one repeat.
* What does not fit by then is grouped by whole windows. Each is itself such a node, whose leader an aggregation with map-side combining finds,
  so that a passage found in a third of all documents never meets in one task.

Stretches that continue each other are put together per document to the maximal repeats. A prefix that occurs once can hold no repeat and is dropped before any text moves.

Defined cases: null or empty text has no words, so nothing is removed (kept text '' for null). Rows without a doc_id
are returned unchanged and are no earlier copy of anything. Rows that repeat a doc_id are judged as that
document: they get the same spans, and are no earlier copies of each other. Documents shorter than `min_words` stay whole. An empty table gives an empty result.
Only doc_id and text are read; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MIN_WORDS = 20
#: Words of a sample point. Every window of MIN_WORDS words holds MIN_WORDS - ANCHOR + 1 candidates.
ANCHOR = 8
#: Words by which the prefix of a group that does not fit is lengthened.
PREFIX_STEP = 6
#: Segments of a group up to which a task builds the subtree itself (about 200 bytes each).
GROUP_SEGMENTS = 50_000
#: Words of segments that a group holds at most: some 280 bytes each while its suffix array is made. A run of equal sample points is one segment however long it is.
GROUP_WORDS = 1_500_000

_ANCHORS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("seen", pa.int32())])
_SEGMENTS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.string()), ("window", pa.binary())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("of_doc", pa.int64()), ("of_start", pa.int32())])
_SPAN_COLUMNS = "doc_id long, start int, n int, of_doc long, of_start int"
_REPORT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, removed array<struct<start:int,n:int>>, repeats array<struct<start:int,n:int,of_doc:bigint,of_start:int>>"


def _sample_points(min_words: int, anchor: int):
    """Rows (doc_id, text) or (doc_id, text, stretches): each sample point with the run of windows it stands for; of windows in the stretches only, where given."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, end, data, offsets in C.text_chunks(batch.column(1)):
                codes, rows = C.word_hashes(data, offsets)
                if len(codes) < min_words:
                    continue
                grams = C.gram_hashes(codes, anchor)
                width = min_words - anchor + 1
                least = C.sliding_min(grams, width)
                own = rows[: len(least)] == rows[min_words - 1 :]
                run_of = np.zeros(len(least), np.int64)
                if batch.num_columns > 2:
                    heads = np.searchsorted(rows, np.arange(end - row))
                    marks = np.zeros(len(least) + 1, np.int64)
                    number = 0
                    for i, stretches in enumerate(batch.column(2).slice(row, end - row).to_pylist()):
                        for x in stretches:
                            s, e = int(heads[i]) + x["start"], min(int(heads[i]) + x["start"] + x["n"], len(least))
                            if s < e:
                                number += 1
                                marks[s] += number
                                marks[e] -= number
                    run_of = np.cumsum(marks)[:-1]
                    own &= run_of > 0
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                keys, docs, runs = least[at], rows[at], run_of[at]
                first = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (runs[1:] != runs[:-1])]
                begin = np.flatnonzero(first)
                n = np.diff(np.r_[begin, len(at)])
                # Periodic stretches can repeat a window within one run: a gram that recurs nearby counts twice.
                again = np.zeros(len(grams) + 1, np.int64)
                for d in range(1, min_words + width):
                    if d < len(grams):
                        again[1 : len(grams) - d + 1] |= grams[:-d] == grams[d:]
                again = np.cumsum(again)
                s = at[begin]
                seen = 1 + ((n > width) | (again[np.minimum(s + n + width - 1, len(grams))] > again[s]))
                doc_start = np.searchsorted(rows, docs[begin])
                yield C.batch_of(_ANCHORS, [pa.array(keys[begin].view(np.int64)), pa.array(ids[row + docs[begin]].astype(np.int64)), pa.array((s - doc_start).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seen.astype(np.int32))])

    return run


def _cut_segments(min_words: int, hot: bool):
    """Rows (doc_id, text, points): the words of each point's stretch, or for hot prefixes a digest of each window."""

    def run(batches):
        for batch in batches:
            keys, docs, starts, texts, windows = [], [], [], [], []
            size = 0
            points = batch.column(2)
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), points):
                if not text.is_valid:
                    continue
                words = C.WORD.findall(text.as_py())
                for p in own.as_py():
                    s, e = p["start"], p["start"] + p["n"] + min_words - 1
                    if e > len(words):
                        continue
                    if hot:
                        for i in range(s, s + p["n"]):
                            w = " ".join(words[i : i + min_words])
                            keys.append(p["key"]), docs.append(doc), starts.append(i), texts.append(None)
                            windows.append(hashlib.blake2b(w.encode(), digest_size=16).digest())
                            size += 50
                    else:
                        w = " ".join(words[s:e])
                        keys.append(p["key"]), docs.append(doc), starts.append(s), texts.append(w), windows.append(None)
                        size += len(w) + 40
                if size > C.CHUNK_BYTES:
                    yield C.batch_of(_SEGMENTS, [keys, docs, starts, texts, windows])
                    keys, docs, starts, texts, windows, size = [], [], [], [], [], 0
            if keys:
                yield C.batch_of(_SEGMENTS, [keys, docs, starts, texts, windows])

    return run


def suffix_array(codes: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): the given suffixes in order, and how many words each has in common with the one before it (0 for the first).

    codes holds segments end to end, between bounds; a suffix ends with its segment. Ranks of prefixes of 1, 2, 4 .. words are made by doubling
    until one covers the longest segment. Then lengths in common are found by going down through the ranks.
    """
    sizes = np.diff(bounds)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    # A mark of its own ends each segment, so that no two suffixes are equal or match beyond an end.
    marked = np.full(len(codes) + len(sizes), -1, np.int64)
    ends = bounds[1:] + np.arange(len(sizes))
    is_end = np.zeros(len(marked), bool)
    is_end[ends] = True
    marked[~is_end] = codes
    marked[is_end] = (codes.max() + 1 if len(codes) else 0) + np.arange(len(sizes))
    starts = starts + segment_of(bounds, starts)
    ranks = [np.unique(marked, return_inverse=True)[1].astype(np.int64)]
    reach, longest = 1, int(sizes.max()) + 1 if len(sizes) else 1
    while reach < longest:
        last = ranks[-1]
        pair = last * (int(last.max()) + 2)
        pair[: len(pair) - reach] += last[reach:] + 1
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int64))
        reach *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    placed = starts[order]
    lcp = np.zeros(len(starts), np.int64)
    if len(starts) > 1:
        a, b, common = placed[:-1], placed[1:], np.zeros(len(starts) - 1, np.int64)
        last = len(marked) - 1
        for k in range(len(ranks) - 1, -1, -1):
            x, y = a + common, b + common
            same = (x <= last) & (y <= last) & (ranks[k][np.minimum(x, last)] == ranks[k][np.minimum(y, last)])
            common += same << k
        lcp[1:] = common
    return order, lcp


def segment_of(bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(bounds, places, "right") - 1


def _later_copies(min_words: int):
    """Whole groups (key, doc_id, start, words), sorted by key: one row for each stretch of later copies that continues one earlier place."""

    def flush(docs, starts, texts):
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        codes = split.values.dictionary_encode().indices.to_numpy().astype(np.int64)
        bounds = split.offsets.to_numpy().astype(np.int64)
        n = np.diff(bounds) - min_words + 1
        segment = np.repeat(np.arange(len(n)), n)
        within = C.spread(n)
        order, lcp = suffix_array(codes, bounds, bounds[:-1][segment] + within)
        doc, pos = np.asarray(docs, np.int64)[segment], np.asarray(starts, np.int64)[segment] + within
        # An interval of the array whose neighbours have min_words in common is an internal node that deep.
        node = np.cumsum(lcp < min_words)
        deep = np.bincount(node)[node] > 1
        leaves, node = order[deep], node[deep]
        if not len(leaves):
            return None
        by_node = np.lexsort((pos[leaves], doc[leaves], node))
        leaves, node = leaves[by_node], node[by_node]
        lead = np.maximum.accumulate(np.where(np.r_[True, node[1:] != node[:-1]], np.arange(len(leaves)), 0))
        leader = leaves[lead]
        # A repeated row is the same place as its twin, not a later one.
        later = (doc[leaves] != doc[leader]) | (pos[leaves] != pos[leader])
        hit, leader = leaves[later], leader[later]
        if not len(hit):
            return None
        sort = np.lexsort((pos[hit], doc[hit]))
        hit, leader = hit[sort], leader[sort]
        d, p, of_doc, of_pos = doc[hit], pos[hit], doc[leader], pos[leader]
        # A place that a repeated row names twice is no break.
        onward = (d[1:] == d[:-1]) & (p[1:] - p[:-1] <= 1) & (of_doc[1:] == of_doc[:-1]) & (of_pos[1:] - of_pos[:-1] == p[1:] - p[:-1])
        begin = np.flatnonzero(np.r_[True, ~onward])
        last = np.r_[begin[1:], len(hit)] - 1
        return C.batch_of(_SPANS, [pa.array(d[begin]), pa.array(p[begin].astype(np.int32)), pa.array((p[last] - p[begin] + min_words).astype(np.int32)), pa.array(of_doc[begin]), pa.array(of_pos[begin].astype(np.int32))])

    def run(batches):
        last, docs, starts, texts = None, [], [], []
        size = 0
        for batch in batches:
            for k, d, s, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if size > C.CHUNK_BYTES and k != last:
                    if (out := flush(docs, starts, texts)) is not None:
                        yield out
                    docs, starts, texts, size = [], [], [], 0
                last = k
                docs.append(d), starts.append(s), texts.append(t)
                size += len(t)
        if docs and (out := flush(docs, starts, texts)) is not None:
            yield out

    return run


def _joined(spans: list[dict]) -> list[dict]:
    """Spans (start, n, of_doc, of_start), those that continue one earlier place put together."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["of_doc"], x["of_start"] - x["start"], x["start"])):
        y = out[-1] if out else None
        if y and y["of_doc"] == x["of_doc"] and y["of_start"] - y["start"] == x["of_start"] - x["start"] and x["start"] <= y["start"] + y["n"]:
            y["n"] = max(y["n"], x["start"] + x["n"] - y["start"])
        else:
            out.append(dict(x))
    return sorted(out, key=lambda x: (x["start"], x["of_doc"], x["of_start"]))


def _apply(batches):
    import pandas as pd

    for pdf in batches:
        out = []
        for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
            words = C.WORD.findall(text) if isinstance(text, str) else []
            merged: list[list[int]] = []
            if spans is not None:
                for s, n in sorted((x["start"], x["n"]) for x in spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s + n)
                    elif s < len(words):
                        merged.append([s, s + n])
            kept, at, gone = [], 0, 0
            for s, e in merged:
                kept += words[at:s]
                gone += min(e, len(words)) - s
                at = e
            kept += words[at:]
            joined = " ".join(kept)
            repeats = _joined([x for x in spans if x["start"] < len(words)]) if spans is not None else []
            out.append((doc, len(words), gone, joined, hashlib.sha256(joined.encode()).hexdigest(), [{"start": s, "n": min(e, len(words)) - s} for s, e in merged], repeats))
        frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "removed", "repeats"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        yield frame


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _exchanged(docs: DataFrame) -> DataFrame:
    """(doc, body) of the rows that have an id. Renamed for every join alike, or Spark would not see that one exchange serves them all."""
    return _keyed(docs).where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("text").alias("body"))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, group_segments: int = GROUP_SEGMENTS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(doc_id, start, n, of_doc, of_start): stretches of words made of windows that also start earlier, and where. Spans of a document may overlap."""
    anchor = min(ANCHOR, max(1, min_words // 2))
    points = _keyed(docs).where("doc_id is not null").mapInArrow(_sample_points(min_words, anchor), "key long, doc_id long, start int, n int, seen int")
    fits = None
    while True:
        held = F.sum((F.col("n") + (min_words - 1)).cast("long"))
        shared = points.groupBy("key").agg(F.sum("seen").alias("total"), held.alias("held")).where("total > 1").select("key", ((F.col("total") > group_segments) | (F.col("held") > group_words)).alias("hot"))
        shared = C.checkpoint(shared)
        own = points.drop("seen").join(shared.where("not hot").select("key"), "key")
        fits = own if fits is None else fits.unionAll(own)
        large = shared.where("hot")
        if large.isEmpty():
            large = None
            break
        large = C.checkpoint(points.drop("seen").join(large.select("key"), "key"))
        anchor += PREFIX_STEP
        if anchor >= min_words:
            break
        # What did not fit is sampled anew by longer prefixes.
        stretches = large.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("stretches"))
        again = _exchanged(docs).join(stretches, F.col("doc") == F.col("doc_id")).select("doc", "body", "stretches")
        points = C.checkpoint(again.mapInArrow(_sample_points(min_words, anchor), "key long, doc_id long, start int, n int, seen int"))

    def cut(mine: DataFrame, hot: bool) -> DataFrame:
        by_doc = mine.groupBy("doc_id").agg(F.collect_set(F.struct("key", "start", "n")).alias("points"))
        return _exchanged(docs).join(by_doc, F.col("doc") == F.col("doc_id")).select("doc", "body", "points").mapInArrow(_cut_segments(min_words, hot), "key long, doc_id long, start int, words string, window binary")

    groups = cut(fits, False).select("key", "doc_id", "start", "words").repartition("key").sortWithinPartitions("key")
    spans = groups.mapInArrow(_later_copies(min_words), _SPAN_COLUMNS)
    if large is None:
        return spans
    # Made twice over, but in one plan with the rest, so that all read one exchange of the texts.
    windows = cut(large, True).select("window", "doc_id", "start")
    earliest = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hot = windows.join(earliest, "window").where("doc_id != least.doc_id or start != least.start").select("doc_id", "start", F.lit(min_words).alias("n"), F.col("least.doc_id").alias("of_doc"), F.col("least.start").alias("of_start"))
    return spans.unionAll(hot)


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, group_segments: int = GROUP_SEGMENTS, group_words: int = GROUP_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256, removed spans, repeats.

    repeats: the maximal repeats, start and n words, and where (of_doc, of_start) the earliest copy of their windows stands.
    """
    spans = repeated_spans(docs, min_words, group_segments, group_words).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "of_doc", "of_start")).alias("spans"))
    own = _keyed(docs)
    judged = _exchanged(docs).join(spans, F.col("doc") == F.col("doc_id"), "left").select(F.col("doc").alias("doc_id"), F.col("body").alias("text"), "spans")
    # Rows without an id keep apart, so that every join above reads one and the same exchange of the texts.
    unjudged = own.where("doc_id is null").withColumn("spans", F.lit(None).cast(judged.schema["spans"].dataType))
    return judged.unionAll(unjudged).mapInPandas(_apply, _REPORT)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(C.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
