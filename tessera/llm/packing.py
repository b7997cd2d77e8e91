"""Best-fit packing of token sequences by minimum bin slack.

Texts are tokenized in the tasks (whole, in batches of distinct words), documents longer than a sequence are cut, and the
plan is made from the histogram of piece lengths alone: at most `max_tokens` counts, whatever the input. Per bin
a bitset subset-sum dynamic programme over the lengths still available finds the fullest combination with the
longest piece; the combination is taken out as many times as the counts allow. Pieces then find their places through their rank among the
pieces of equal length, ranked in hash buckets so that a length that a third of all pieces share is spread out.

Defined cases: null and empty texts are documents of one token (the end token), each a piece of its own. Rows that
repeat a doc_id, or have none, are packed as documents of their own. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C

MAX_TOKENS = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct pieces whose ids a Python worker remembers (some 150 bytes each) before it starts anew.
REMEMBERED_PIECES = 600_000


class WordIds:
    """Token ids of texts by way of their distinct pieces, each given to the tokenizer once.

    Pieces are what the tokenizer's own pattern splits: runs of letters, single digits, runs of other characters, and the endings
    's 't 're 've 'm 'll 'd. They are found here for ASCII and Latin-1 letters, whose lower case and composed form are plain;
    a space-separated word with any other character, or with the mark of a special token, goes to the tokenizer whole. The
    vocabulary closes each piece with a token that carries an end mark, by which the ids of joined pieces are told apart.
    """

    SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3

    def __init__(self, path: str, remembered: int = REMEMBERED_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = np.full(256, self.OTHER, np.uint8)
        self.kind[[9, 10, 11, 12, 13, 32]] = self.SPACE
        self.kind[48:58] = self.DIGIT
        self.kind[97:123] = self.kind[65:91] = self.kind[128:] = self.LETTER
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts = np.zeros(0, np.uint16 if len(self.closes) <= 1 << 16 else np.uint32), np.zeros(1, np.int64)

    def _learn(self, plain: list[bytes], whole: list[bytes]) -> None:
        ids, sizes = [], []
        for at in range(0, len(plain), 4000):
            got = np.asarray(self.tokenizer.encode_batch_fast([b" ".join(plain[at : at + 4000]).decode()], add_special_tokens=False)[0].ids)
            ids.append(got)
            sizes.append(np.diff(np.flatnonzero(self.closes[got]), prepend=-1))
        for at in range(0, len(whole), 4000):
            codes = self.tokenizer.encode_batch_fast([w.decode() for w in whole[at : at + 4000]], add_special_tokens=False)
            ids += [np.asarray(c.ids, np.int64) for c in codes]
            sizes.append(np.array([len(c.ids) for c in codes]))
        known = len(self.starts) - 1
        self.place.update(zip([*plain, *whole], range(known, known + len(plain) + len(whole))))
        self.ids = np.concatenate([self.ids, *(x.astype(self.ids.dtype) for x in ids)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without white space and in lower case, piece starts there, whether a byte belongs to a word that stays whole)."""
        n = len(data)
        after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        after[:-1], before[1:] = data[1:], data[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        kind = self.kind[data]
        fresh = np.zeros(n, bool)
        fresh[0] = fresh[inner] = True
        previous = np.zeros(n, np.uint8)
        previous[1:] = kind[:-1]
        previous[fresh] = self.SPACE
        high = data >= 128
        tail = high & (before == 0xC3)
        odd = high & ~tail & (data != 0xC3) | tail & ((data == 0x97) | (data == 0xB7)) | (data < 32) & (kind != self.SPACE) | (data == 127) | (data == 60) & (after == 124)
        low = np.where((data >= 65) & (data <= 90) | tail & (data <= 0x9E), data | np.uint8(32), data)
        solid = kind != self.SPACE
        word_starts = np.flatnonzero(solid & (previous == self.SPACE))
        whole = np.zeros(n, bool)
        if odd.any():
            word = np.cumsum(solid & (previous == self.SPACE)) - 1
            stays = np.zeros(len(word_starts), bool)
            stays[word[odd]] = True
            whole = solid & stays[np.maximum(word, 0)]
        start = solid & ((kind != previous) | (kind == self.DIGIT))
        marks = np.flatnonzero((data == 39) & (previous != self.OTHER))
        if len(marks):
            pad = np.r_[low, np.zeros(3, np.uint8)]
            edge = np.r_[fresh | ~solid, np.ones(3, bool)]
            one, two = pad[marks + 1], pad[marks + 2]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~edge[marks + 1]
            long = ((one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)) & ~edge[marks + 1] & ~edge[marks + 2]
            start[marks[short | long] + 1] = False
            for ends, width in ((marks[short], 2), (marks[long], 3)):
                ends = ends[ends + width < n] + width
                start[ends[solid[ends]]] = True
        start = np.where(whole, False, start)
        start[word_starts] = True
        out = np.where(whole, data, low)
        return out[solid], np.flatnonzero(start[solid]), whole[solid]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows end to end, bounds of each row's ids), chunk by chunk."""
        for row, end, data, offsets in C.text_chunks(texts, 4 * C.CHUNK_BYTES):
            if not len(data):
                yield row, np.zeros(0, np.uint32), np.zeros(end - row + 1, np.int64)
                continue
            solid_before = np.r_[0, np.cumsum(self.kind[data] != self.SPACE)][offsets]
            out, starts, whole = self._pieces(data, offsets)
            bounds = np.r_[starts, len(out)].astype(np.int64)
            column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out))])
            coded = column.dictionary_encode()
            distinct, where = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            first = np.zeros(len(distinct), np.int64)
            first[where[::-1]] = np.arange(len(where))[::-1]
            stays = whole[starts[first]] if len(starts) else np.zeros(0, bool)
            if len(self.place) > self.remembered:
                self._forget()
            known = list(map(self.place.get, distinct))
            new = [i for i, k in enumerate(known) if k is None]
            if new:
                self._learn([distinct[i] for i in new if not stays[i]], [distinct[i] for i in new if stays[i]])
                known = list(map(self.place.__getitem__, distinct))
            place = np.array(known, np.int64)[where] if len(where) else np.zeros(0, np.int64)
            n = self.starts[place + 1] - self.starts[place]
            ids = self.ids[np.repeat(self.starts[place], n) + C.spread(n)]
            yield row, ids, np.r_[0, np.cumsum(n)][np.searchsorted(starts, solid_before)]


_encoders: dict[str, WordIds] = {}

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at `max_tokens`."""

    def run(batches):
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            docs_of = batch.column(0).to_pylist()
            for row, ids, bounds in encoder.encode(batch.column(1)):
                rows = []
                for i in range(len(bounds) - 1):
                    tokens = np.append(ids[bounds[i] : bounds[i + 1]], ids.dtype.type(end_id)).astype("<u4")
                    rows += [(docs_of[row + i], k, s, min(max_tokens, len(tokens) - s), zlib.crc32(tokens[s : s + max_tokens].tobytes())) for k, s in enumerate(range(0, len(tokens), max_tokens))]
                yield C.batch_of(_PIECES, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest_fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) drawn from counts that fill as much of `room` as any combination can."""
    reach, steps, want = 1, [], 1 << room
    mask = (1 << room + 1) - 1
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, part = min(int(counts[length]), room // length), 1
        while left and not reach & want:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, part = left - take, part * 2
        if reach & want:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def slack_plan(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram: (times, [(length, copies)]) whose bins hold every piece once."""
    counts = np.zeros(max_tokens + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = []
    for length in range(max_tokens, 0, -1):
        while counts[length]:
            counts[length] -= 1
            fill = fullest_fill(counts, max_tokens - length)
            counts[length] += 1
            merged = dict(fill)
            merged[length] = merged.get(length, 0) + 1
            times = min(int(counts[x]) // n for x, n in merged.items())
            for x, n in merged.items():
                counts[x] -= n * times
            plan.append((times, sorted(merged.items(), reverse=True)))
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, in order of rank: first rank of a run of places, its first sequence, and its offset in the sequence."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, pattern in plan:
        offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                rows.setdefault(length, []).append((rank.get(length, 0), sequence, offset))
                rank[length] = rank.get(length, 0) + times
                offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


def pack_pieces(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Add sequence_id and offset to pieces (length, ..). They are written out once, with a number each, so that equal ones are spread out as well."""
    pieces = C.checkpoint(pieces.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = _places(slack_plan(histogram, max_tokens))
    # Rows of a bucket and buckets of a length both stay near the root of the row count.
    buckets = max(1, math.ceil(math.sqrt(sum(histogram.values())) / 8))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("_row")
    ranked = keyed.withColumn("rank", F.row_number().over(within)).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("rank") - 1).drop("bucket", "first", "_row")

    def put(batches):
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(lengths[order]) != 0, True]) if len(order) else []
            for s, e in zip(bounds[:-1], bounds[1:]):
                at = order[s:e]
                firsts, bases, offsets = places[int(lengths[at[0]])]
                k = np.searchsorted(firsts, ranks[at], "right") - 1
                sequence[at], offset[at] = bases[k] + ranks[at] - firsts[k], offsets[k]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(put, schema)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs, tokenizer, max_tokens, end_id), max_tokens).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"), tokenizer_path())
