"""Alignment of two tokenizers over the same bytes by merging their token ends in lockstep.

The documents of a batch advance together: a state of two pointers per document, held as vectors, is moved by one vectorised step for all of
them. A step links the two tokens at the pointers (their bytes overlap), moves on whichever ends first, or both where both end, which is a
cut, and drops finished documents from the state. A batch takes as many steps as its longest document has links.

Encoding goes by distinct words: a text is cut where white space follows another character, but for white space that some piece of a vocabulary
has in such a place. So no token spans a cut, and each word with the white space before it is encoded once and remembered, up to a bound. Texts with a
character that the two tokenizers' and Python's notions of white space disagree on go to the tokenizers whole.

Each document's distinct id pairs, with how often they are linked, are written once; counting documents per pair, and finding each A id's
highest count, are aggregates over them. Counts return to documents by a broadcast up to `BROADCAST_PAIRS` pairs (counted first), by a shuffle beyond.

Defined cases: texts that are null, empty, or not rendered byte for byte by both tokenizers have no tokens: zeros and an empty `groups`. Rows without a
doc_id and repeated rows are documents of their own. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast: 20 bytes each.
BROADCAST_PAIRS = 3_000_000
#: Bytes of text that a task aligns at once; a longer document is taken whole.
BATCH_BYTES = 768 << 10
#: Distinct words, and characters of them, that a Python worker remembers with their ids before it starts anew.
REMEMBERED_WORDS, REMEMBERED_CHARACTERS = 400_000, 16 << 20
#: White space to one of the two tokenizers or to Python, but not to all.
_DISPUTED = re.compile("[\x1c-\x1f\x85᠎​▁]")
_DOCUMENT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.list_(pa.int32())) for c in ("a", "b", "times"))])


class _Side:
    """One tokenizer: ids of a string that begins with the space, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            n = model.get_piece_size()
            self.bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(n))]
            # The model adds the space itself.
            self.encode = lambda texts: model.encode([t[1:] for t in texts], num_threads=1)
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            # The printable stand-ins of a byte-level vocabulary: printable bytes are themselves, the others count up from 256.
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
            byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
            words = model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(words.values()) + 1)
            for w, i in words.items():
                self.bytes[i] = bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode()
            self.encode = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        self.sizes = np.array([len(b) for b in self.bytes], np.int32)
        #: White space that follows another character within a piece, where texts can't be cut.
        self.inner = {c for b in self.bytes for c in re.findall(r"\S(\s)", b.decode("utf-8", "ignore"))}


class PairedIds:
    """Ids of both tokenizers for the words of texts, each distinct word encoded once."""

    def __init__(self, path_a: str, path_b: str, remembered: int = REMEMBERED_WORDS) -> None:
        self.sides = (_Side(path_a), _Side(path_b))
        inner = "".join(sorted(self.sides[0].inner | self.sides[1].inner))
        self.word = re.compile(rf"\s*\S+(?:[{re.escape(inner)}]\s*\S*)*|\s+" if inner else r"\s*\S+|\s+")
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.characters = 0
        self.right = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _learn(self, words: list[str]) -> None:
        """Words that begin with a space: those that end in white space or hold a disputed character one by one, the others many at once."""
        alone = [w for w in words if w[-1].isspace() or _DISPUTED.search(w)]
        if alone:
            apart = set(alone)
            words = [w for w in words if w not in apart]
        learnt = [self._told_apart(words[at : at + 2000]) for at in range(0, len(words), 2000)] + [self._one_by_one(alone)]
        words += alone
        self.place.update(zip(words, range(len(self.right), len(self.right) + len(words))))
        self.characters += sum(map(len, words))
        self.right = np.concatenate([self.right, *(right for right, _, _ in learnt)])
        for k in (0, 1):
            self.ids[k] = np.concatenate([self.ids[k], *(ids[k] for _, ids, _ in learnt)])
            self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(np.concatenate([counts[k] for _, _, counts in learnt]))])

    def _told_apart(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(whether each word is rendered by both, ids, how many of each word) from the ids of all words in one string, told apart by their bytes."""
        whole = "".join(words)
        want, bounds = whole.encode(), np.cumsum([len(w.encode()) for w in words])
        ids, counts = [], []
        for side in self.sides:
            own = side.encode([whole])[0]
            ends = np.cumsum(side.sizes[own])
            last = np.searchsorted(ends, bounds)
            if not len(ends) or ends[-1] != bounds[-1] or (ends[last] != bounds).any() or b"".join(map(side.bytes.__getitem__, own)) != want:
                return self._one_by_one(words)
            ids.append(np.array(own, np.int32))
            counts.append(np.diff(last, prepend=-1))
        return np.ones(len(words), bool), ids, counts

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        right, ids, counts = np.ones(len(words), bool), [], []
        for side in self.sides:
            # A lone space after a word is what is left of " a " without its first token.
            found = [side.encode([w])[0] if w != " " else side.encode([" a "])[0][-1:] for w in words]
            right &= np.array([b"".join(map(side.bytes.__getitem__, own)) == w.encode() for own, w in zip(found, words)], bool)
            ids.append(np.array([i for own in found for i in own], np.int32))
            counts.append(np.array([len(own) for own in found], np.int64))
        return right, ids, counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(whether each text is rendered by both, ids of both sides end to end, bounds of each text's ids on both sides)."""
        words: list[str] = []
        counts = []
        for t in texts:
            if not t:
                counts.append(0)
                continue
            t = f" {t}"
            own = self.word.findall(t) if not _DISPUTED.search(t) else [t]
            words += own
            counts.append(len(own))
        if len(self.place) > self.remembered or self.characters > REMEMBERED_CHARACTERS:
            self._forget()
        fresh = {w for w in words if w not in self.place}
        spaced = sorted(w for w in fresh if w[0] == " ")
        self._learn(spaced)
        self._learn_others(sorted(fresh.difference(spaced)))
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        counts = np.array(counts, np.int64)
        first = np.r_[0, np.cumsum(counts)]
        wrong = np.r_[0, np.cumsum(~self.right[at])]
        right = (counts > 0) & (wrong[first[1:]] == wrong[first[:-1]])
        at = at[np.repeat(right, counts)]
        counts = np.where(right, counts, 0)
        first = np.r_[0, np.cumsum(counts)]
        ids, bounds = [], []
        for own, starts in zip(self.ids, self.starts):
            n = starts[at + 1] - starts[at]
            ids.append(own[np.repeat(starts[at], n) + C.spread(n)])
            bounds.append(np.r_[0, np.cumsum(n)][first])
        return right, ids, bounds

    def _learn_others(self, words: list[str]) -> None:
        """Words that begin with other white space: encoded behind a word of their own, whose ids are then taken off."""
        if not words:
            return
        lead, base = " a", len(self.right)
        self._learn([lead + w for w in words])
        for k, side in enumerate(self.sides):
            off, start = len(side.encode([lead])[0]), self.starts[k][base]
            n = np.diff(self.starts[k][base:])
            self.ids[k] = np.r_[self.ids[k][:start], self.ids[k][start:][C.spread(n) >= off]]
            self.starts[k] = np.r_[self.starts[k][: base + 1], start + np.cumsum(n - off)]
        for w in words:
            self.place[w] = self.place.pop(lead + w)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, A token, B token, whether it is a cut) of every link, in the order of the steps. ends: byte ends within each document; bounds: of each document's tokens."""
    doc = np.flatnonzero(bounds_a[1:] > bounds_a[:-1]).astype(np.int32)
    a, b, stop = bounds_a[:-1][doc].astype(np.int32), bounds_b[:-1][doc].astype(np.int32), bounds_a[1:][doc].astype(np.int32)
    out: list[tuple[np.ndarray, ...]] = []
    while len(doc):
        end_a, end_b = ends_a[a], ends_b[b]
        move_a, move_b = end_a <= end_b, end_b <= end_a
        out.append((doc, a, b, move_a & move_b))
        a, b = a + move_a, b + move_b
        if (a >= stop).any():
            live = a < stop
            doc, a, b, stop = doc[live], a[live], b[live], stop[live]
    if not out:
        none = np.zeros(0, np.int32)
        return none, none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bytes for each number below n, its decimal digits from the left with room for a separator behind, and how many digits."""
    wide = len(str(max(1, n - 1)))
    numbers = np.arange(n)
    sizes = np.searchsorted(10 ** np.arange(1, wide + 1), numbers, "right") + 1
    table = np.zeros((n, wide + 1), np.uint8)
    for k in range(wide):
        power = np.maximum(sizes - 1 - k, 0)
        table[:, k] = np.where(k < sizes, 48 + numbers // 10**power % 10, 0)
    return table, sizes.astype(np.int64)


def _groups_text(ids: list[np.ndarray], last: list[np.ndarray], bounds: list[np.ndarray], tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets by document) of `a1,a2|b1;a3|b2,b3;`: ids of both sides, with flags of the tokens that end a group."""
    group = [np.cumsum(x) - x for x in last]
    before = [np.r_[0, np.cumsum(np.bincount(g, minlength=1))] for g in group]
    place_a = np.arange(len(ids[0])) + before[1][group[0]] if len(ids[0]) else np.zeros(0, np.int64)
    place_b = np.arange(len(ids[1])) + before[0][group[1] + 1] if len(ids[1]) else np.zeros(0, np.int64)
    sizes = np.zeros(len(ids[0]) + len(ids[1]), np.int64)
    for own, place, (_, digits) in zip(ids, (place_a, place_b), tables):
        sizes[place] = digits[own] + 1
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(int(starts[-1]), np.uint8)
    for own, ends, place, (table, digits), mark in zip(ids, last, (place_a, place_b), tables, b"|;"):
        at, size = starts[place], digits[own]
        for k in range(table.shape[1] - 1):
            some = np.flatnonzero(size > k) if k else slice(None)
            out[at[some] + k] = table[own[some], k]
        out[at + size] = np.where(ends, np.uint8(mark), np.uint8(44))
    return out, starts[bounds[0] + bounds[1]]


def _alike(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Rows of texts by length, up to `size` bytes at once: documents of like length advance together, so that few steps have few documents."""
    rows = pc.sort_indices(pc.binary_length(texts))
    total = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).take(rows).to_numpy(), dtype=np.int64)]
    first = 0
    while first < len(rows):
        end = max(first + 1, int(np.searchsorted(total, total[first] + size, "right")) - 1)
        yield rows.slice(first, end - first)
        first = end


def _of_batch(batch: pa.RecordBatch, encoder: PairedIds, tables: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    right, ids, bounds = encoder.encode(batch.column(2).to_pylist())
    ends = []
    for side, own, bound in zip(encoder.sides, ids, bounds):
        total = np.r_[0, np.cumsum(side.sizes[own], dtype=np.int64)]
        ends.append((total[1:] - np.repeat(total[bound[:-1]], np.diff(bound))).astype(np.int32))
    doc, a, b, cut = lockstep(ends[0], ends[1], bounds[0], bounds[1])
    last = [np.zeros(len(x), bool) for x in ids]
    last[0][a[cut]] = last[1][b[cut]] = True
    n = len(right)
    n_links, n_groups = np.bincount(doc, minlength=n), np.bincount(doc[cut], minlength=n)
    text, offsets = _groups_text(ids, last, bounds, tables)
    held = memoryview(text)
    sha = [hashlib.sha256(held[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    n_a, n_b = (len(s.bytes) for s in encoder.sides)
    key = (doc.astype(np.int64) * n_a + ids[0][a]) * n_b + ids[1][b]
    key.sort()
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    times = np.diff(np.r_[fresh, len(key)])
    of_doc, pair = np.divmod(key[fresh], n_a * n_b)
    at = pa.array(np.r_[0, np.cumsum(np.bincount(of_doc, minlength=n))].astype(np.int32))
    lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (pair // n_b, pair % n_b, times)]
    return C.batch_of(_DOCUMENT, [batch.column(0), batch.column(1), np.diff(bounds[0]), np.diff(bounds[1]), n_groups, n_links, sha, *lists])


def aligned(docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document of docs (row, doc_id, text): row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and its distinct linked id pairs (a, b, times)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PairedIds(path_a, path_b)
        tables = [_digits(len(s.bytes)) for s in encoder.sides]
        for batch in batches:
            for rows in _alike(batch.column(2), batch_bytes):
                yield _of_batch(batch.take(rows), encoder, tables)

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(align, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, held, best) of linked id pairs: documents that hold it, and whether no other pair of the A id is held by more."""
    pairs = found.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"))
    pairs = C.written(pairs)
    most = pairs.groupBy("a").agg(F.max("held").alias("most"))
    return pairs.join(most, "a").select("a", "b", "held", (F.col("held") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = C.written(aligned(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), path_a, path_b))
    counts = C.written(pair_counts(found))
    if counts.count() <= broadcast_pairs:
        counts = F.broadcast(counts)
    links = found.select("row", F.inline(F.arrays_zip("a", "b", "times"))).join(counts, ["a", "b"])
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"), F.sum(F.col("times") * F.col("held")).cast("long").alias("count_sum"))
    both = found.drop("a", "b", "times").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(C.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B))
