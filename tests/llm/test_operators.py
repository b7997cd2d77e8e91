"""Each corpus operator against its definition, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import _common as C
from tessera.llm import components, decontaminate, langid, line_dedup, media_tiff, near_dedup, packing, sharding, substring_dedup, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def _odd_rows():
    """Null, empty, blank, one word, very long, repeated rows, no id."""
    shared = _words(30, 1)
    long = _words(6000, 2)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, shared + " tail " + _words(40, 3)), (7, _words(40, 4) + "  " + shared.replace(" ", "\t") + "\nend"), (8, "a b " * 60), (9, shared), (9, shared), (None, shared), (10, "é ü " * 15 + "漢字 " * 15)]
    return [(d, t, None if d in (4, 8) else "en", f"s{(d or 0) % 2}" if d != 6 else None, len(t or "")) for d, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(_odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _clash(df):
    """Extra columns named like what the operators make on the way."""
    return df.withColumn("words", F.lit(1)).withColumn("key", F.lit("k")).withColumn("h", F.lit(2.0)).withColumn("start", F.lit(0)).withColumn("n", F.lit(3)).withColumn("pos", F.lit(0)).withColumn("band", F.lit(0)).withColumn("score", F.lit(0)).withColumn("n_lines", F.lit("x"))


def _substrings(rows, k):
    first, gone = {}, collections.defaultdict(set)
    words = {d: C.WORD.findall(t or "") for d, t in rows if d is not None}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            if first.setdefault(tuple(words[d][i : i + k]), (d, i)) != (d, i):
                gone[d] |= set(range(i, i + k))
    return {d: (len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in words.items()}


@pytest.mark.parametrize(("k", "limit"), [(20, 50_000), (20, 1), (6, 2)])
def test_substrings(spark, odd, k, limit):
    got = substring_dedup.dedup_substrings(_clash(odd), k, limit).collect()
    want = _substrings([(r[0], r[1]) for r in _odd_rows()], k)
    assert len(got) == 12
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_text"]) == want[r["doc_id"]]
        assert r["kept_sha256"] == hashlib.sha256(r["kept_text"].encode()).hexdigest()


def test_substrings_of_random_texts(spark):
    r = random.Random(5)
    pieces = [_words(r.randint(5, 45), i, 12) for i in range(12)]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 4)))) for i in range(60)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 20, 3).collect()
    want = _substrings(rows, 20)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in got} == want


@pytest.mark.parametrize("group_words", [1_500_000, 400])
def test_substrings_of_equal_words(spark, group_words):
    """Runs of one word, or of two by turns, are one segment each: groups are bounded by their words."""
    rows = [(i, " ".join(["the"] * (30 + i))) for i in range(12)] + [(20 + i, " ".join(["=", "a"] * (40 + i)) + f" end{i}") for i in range(6)] + [(40, _words(50, 9))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20, group_words=group_words).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_text"]) for x in got} == _substrings(rows, 20)


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    for _ in range(30):
        segments = [[r.randrange(3) for _ in range(r.randint(1, 40))] for _ in range(r.randint(1, 6))]
        bounds = np.cumsum([0, *map(len, segments)])
        codes = np.array([x for s in segments for x in s])
        starts = np.array([bounds[i] + k for i, s in enumerate(segments) for k in range(len(s))])
        suffix = lambda at: tuple(codes[at : bounds[substring_dedup.segment_of(bounds, np.array([at]))[0] + 1]])
        order, lcp = substring_dedup.suffix_array(codes, bounds, starts)
        got = [suffix(starts[i]) for i in order]
        for x, y, n in zip(got, got[1:], lcp[1:]):
            common = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
            # A segment's end comes after all words.
            assert n == common and (x[common : common + 1] or (9,)) <= (y[common : common + 1] or (9,))


def test_a_passage_of_500_words_is_one_maximal_repeat(spark):
    passage = _words(500, 77, 5000)
    rows = [(1, f"{_words(40, 78)} {passage} {_words(30, 79)}"), (2, f"{_words(15, 80)} {passage}"), (3, _words(100, 81)), (4, " ".join(passage.split(" ")[100:300]))]
    for limit in (8_000, 1):
        got = {r["doc_id"]: [tuple(x) for x in r["repeats"]] for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 20, limit).collect()}
        assert got == {1: [], 2: [(15, 500, 1, 40)], 3: [], 4: [(0, 200, 1, 140)]}


def test_substrings_of_an_empty_table(spark, empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_tiff_forms_round_trip():
    a = np.random.default_rng(0).integers(0, 4, (40, 50, 3), dtype=np.uint8)
    for compression, predictor, tile in itertools.product((1, 5, 8, 32773), (1, 2), (None, (16, 32))):
        pages = list(media_tiff.read_pages(media_tiff.encode_tiff([a, a[:7, :, :1]], compression, predictor, 13, tile)))
        assert (pages[0] == a).all() and (pages[1] == a[:7, :, :1]).all()
    for n in (0, 1, 253, 254, 255, 765, 767, 9000):
        d = bytes(random.Random(n).choice(b"abc") for _ in range(n))
        assert media_tiff.lzw_decode(media_tiff.lzw_encode(d)) == d and media_tiff.packbits_decode(media_tiff.packbits_encode(d), n) == d


def test_tiff_pages(spark, odd, empty):
    stored = media_tiff.images_of_texts(_clash(odd))
    got = media_tiff.decode_pages(stored.withColumn("k", F.struct("doc_id", "n_bytes")), "k", "image").collect()
    want = sorted((t or "").encode() for _, t, *_ in _odd_rows())
    assert sorted(bytes(r["samples"])[: r["key"]["n_bytes"]] for r in got) == want and all(r["page"] == 0 and len(r["samples"]) % 576 == 0 and len(r["samples"]) for r in got)
    bad = spark.createDataFrame([(1, None), (2, b"no"), (3, b"II*\0\x08\0\0\0" + b"\0\0" + b"\x08\0\0\0")], "k int, image binary")
    assert [(r["key"], r["page"]) for r in media_tiff.decode_pages(bad, "k", "image").where("error is not null").orderBy("key").collect()][:2] == [(1, -1), (2, -1)]
    assert media_tiff.images_of_texts(empty).count() == 0


def test_stored_payloads(spark, odd, tmp_path):
    """Every column of the query against a plain computation; the longest text has more than one page."""
    rows = _odd_rows() + [(50, "0123456789abcdef" * 60_000, None, None, 0), (51, "x" * 576, None, None, 0), (52, "é" * 288, None, None, 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = media_tiff.op2_tiff_pages(spark, str(tmp_path)).collect()
    want = []
    for d, t, *_ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        image = media_tiff.text_image(payload)
        assert b"".join(x.tobytes() for x in media_tiff.read_pages(image)) == payload
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), media_tiff.features(np.frombuffer(payload, np.uint8)), -(-len(payload) // (576 * media_tiff.PAGE_ROWS)), None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want)) and max(r["n_pages"] for r in got) == 2


def _tiff(order, bits, page, width=None, predictor=1, extra=()):
    """One page of unsigned samples as a stored strip, in either byte order."""
    import struct

    raw = page.astype(f"{order}u{bits // 8}")
    if predictor == 2:
        raw = np.concatenate([raw[:, :1], raw[:, 1:] - raw[:, :-1]], axis=1).astype(raw.dtype)
    raw = raw.tobytes()
    tags = [(256, 4, width or page.shape[1]), (257, 4, page.shape[0]), (258, 3, bits), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(raw)), (317, 3, predictor), *extra]
    entries = b"".join(struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "I", v) if k == 4 else struct.pack(order + "HH", v, 0)) for t, k, v in tags)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(raw)) + raw + struct.pack(order + "H", len(tags)) + entries + bytes(4)


@pytest.mark.parametrize(("order", "bits", "predictor"), itertools.product("<>", (8, 16), (1, 2)))
def test_tiffs_of_either_byte_order_and_size(order, bits, predictor):
    page = np.random.default_rng(bits).integers(0, 1 << bits, (5, 7))
    (got,) = media_tiff.read_pages(_tiff(order, bits, page, predictor=predictor))
    assert (got[:, :, 0].astype(np.int64) == page).all()


def test_corrupt_images_are_error_rows(spark):
    page = np.arange(35).reshape(5, 7)
    good = _tiff("<", 8, page)
    images = [good, _tiff("<", 8, page, width=1 << 31), good[:40], good[:-9], b"", b"MM\0*", good[:4] + b"\xff\xff\xff\x7f" + good[8:], _tiff("<", 8, page, extra=[(322, 4, 1 << 30), (323, 4, 1 << 30), (324, 4, 8), (325, 4, 35)]), None]
    got = media_tiff.decode_pages(spark.createDataFrame(list(enumerate(images)), "k int, image binary").repartition(2), "k", "image").collect()
    assert {r["key"] for r in got if r["error"] is None} == {0} and {r["key"] for r in got if r["error"]} == set(range(1, len(images)))


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    import pyarrow as pa

    plain, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), remembered=200)
    r = random.Random(0)
    parts = [*"aB'sTreL9., \n\t", "é", "ß", "ÿ", "Ā", "×", "²", "€", "́", "\x1c", "\x85", "\xa0", "\0", "İ", "'s", "'LL", "<|endoftext|>", "<|"]
    texts = ["", None, "'s", "a's", *("".join(r.choice(parts) for _ in range(r.randint(1, 25))) for _ in range(2000))]
    got = [ids[b[i] : b[i + 1]].tolist() for _, ids, b in own.encode(pa.array(texts, pa.string())) for i in range(len(b) - 1)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, odd, empty):
    got = packing.pack_documents(_clash(odd), packing.tokenizer_path(), max_tokens=512).collect()
    assert packing.pack_documents(empty, packing.tokenizer_path()).count() == 0
    by_sequence = collections.defaultdict(list)
    for r in got:
        assert 1 <= r["length"] <= 512 and r["start"] == 512 * r["piece"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by_sequence) == -(-sum(r["length"] for r in got) // 512)


def test_pieces_are_those_of_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for d, t, *_ in _odd_rows():
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(d, k, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packing.pack_documents(odd, packing.tokenizer_path(), max_tokens=512).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_equal_rows_are_spread(spark):
    rows = spark.createDataFrame([(None if i % 2 else 7, "same", "hot") for i in range(3000)] + [(i, "x", "s") for i in range(1000)], "doc_id long, text string, source string").repartition(5)
    told = sharding._told_apart(rows.withColumn("size", F.lit(5)), ["source", "doc_id", "text"], 4000)
    assert told.where("_twin = 0").count() <= 1002 and told.select("_twin").distinct().count() >= 2999
    placed = sharding.shard_documents(rows).collect()
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(s, k) for s in range(8) for k in range(500)]
    for s in range(8):
        assert abs(sum(r["size"] == 5 for r in placed if r["shard"] == s) - 375) <= 2
    packed = packing.pack_documents(rows, packing.tokenizer_path(), max_tokens=64).collect()
    assert len(packed) == 4000 and len({(r["sequence_id"], r["offset"]) for r in packed}) == 4000


def test_shards_carry_sizes_and_checksums(spark, odd):
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.shard_documents(odd).collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in _odd_rows()), key=str)


def test_fullest_fill_is_the_fullest():
    r = random.Random(3)
    for _ in range(40):
        counts = np.zeros(41, np.int64)
        for _ in range(r.randint(1, 6)):
            counts[r.randint(1, 40)] += r.randint(1, 3)
        room = r.randint(1, 40)
        items = [x for x in range(41) for _ in range(counts[x])]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        fill = packing.fullest_fill(counts, room)
        assert sum(x * n for x, n in fill) == best and all(n <= counts[x] for x, n in fill)


def test_sharding(spark, odd, empty):
    assert sharding.shard_documents(empty).count() == 0
    got = sharding.shard_documents(_clash(odd), 8).collect()
    assert len(got) == 12 and {r["law"] for r in got} == {"rows"}
    rows = spark.range(3001).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    placed = sharding.shard_documents(rows).collect()
    sizes = collections.Counter(r["shard"] for r in placed)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sizes[s]))
    for counts in (collections.Counter((r["source"], r["shard"]) for r in placed),):
        for source in {r["source"] for r in placed}:
            each = [counts[source, s] for s in range(8)]
            assert max(each) - min(each) <= 2
    again = sharding.shard_documents(rows.repartition(7)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in placed}


def _spoken(spark):
    r = random.Random(1)
    stems = {"aa": ["baka", "doko", "mana", "naka"], "bb": ["stri", "chten", "pfeil", "und"], "cc": ["ció", "que", "ente", "los"]}
    rows = [(i, " ".join(r.choice(stems[k]) + r.choice(stems[k]) for _ in range(r.randint(3, 60))), k, "s", 0) for i in range(240) for k in [r.choice(sorted(stems))]]
    return rows, spark.createDataFrame(rows, DOCS)


def test_language_id(spark, odd, empty):
    rows, docs = _spoken(spark)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang, *_ in held]) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())
    strange = langid.identify(_clash(odd), model)
    assert {r["doc_id"]: r["lang_pred"] for r in strange.where("doc_id in (1, 2, 3)").collect()} == {1: "und", 2: "und", 3: "und"}
    assert strange.where("rejected").count() >= 3 and strange.count() == 12
    assert langid.fit(empty) is None and {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_the_language_model_does_not_depend_on_partitions(spark):
    _, docs = _spoken(spark)
    a, b = langid.fit(docs.repartition(2), 100), langid.fit(docs.repartition(9), 100)
    assert (a.table == b.table).all() and a.threshold == b.threshold and a.temperature == b.temperature


def test_a_score_does_not_depend_on_the_batch(spark):
    rows, docs = _spoken(spark)
    model = langid.fit(docs)
    alone = {d: model.scores([t]).max() for d, t, *_ in rows}
    assert {r["doc_id"]: r["score"] for r in langid.identify(docs.repartition(5), model).collect()} == alone


def test_unlearned_languages_are_rejected(spark):
    import os

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    docs = C.table(spark, data, "documents")
    model = langid.fit(docs)
    strange = ["これは日本語の文章です。今日は天気がいいですね。", "Это русский текст о погоде и о том, как прошёл день.", "Ez egy magyar szöveg az időjárásról és a napról.", "asdf jkl qwer zxcv poiu lkjh mnbv asdfg hjkl", "这是一个中文句子,关于天气。", "for (int i = 0; i < n; i++) { sum += a[i]; }"]
    assert (model.scores([t * 3 for t in strange]).max(axis=1) < model.threshold).all()
    # Leave one language out: most of its documents are rejected, few of the others.
    held = docs.where("lang is not null and text is not null and n_chars > 200 and crc32(cast(doc_id as string)) % 4 = 2")
    for lang in ("es", "fr"):
        found = {r["own"]: r["share"] for r in langid.identify(held, langid.fit(docs.where(F.col("lang") != lang))).groupBy((F.col("lang") == lang).alias("own")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
        print(lang, found)
        assert found[True] > 0.5 and found[False] < 0.05


def test_url_history(spark):
    day = lambda x: f"2020-01-{x:02}"
    entries = spark.createDataFrame(
        [("spam", "domain", "x.com", "add", day(5)), ("spam", "domain", "x.com", "remove", day(10)), ("spam", "domain", "x.com", "add", day(20)), ("allow", "host", "ok.x.com", "add", day(1)), ("malware", "prefix", "ok.x.com/bad", "add", day(1)), ("spam", "host", "y.com", "add", day(3)), ("spam", "host", "y.com", "remove", day(3)), (None, "host", "z.com", "add", day(1))],
        "list string, kind string, pattern string, action string, day string",
    ).withColumn("day", F.to_date("day"))
    urls = [(1, "http://a.x.com/p", 4), (2, "http://a.x.com/p", 5), (3, "http://a.x.com/p", 10), (4, "http://a.x.com/p", 25), (5, "https://ok.x.com/fine", 7), (6, "https://u@OK.x.com:8/bad/q?z", 7), (7, "http://y.com", 9), (8, None, 9), (9, "no url", 9), (10, "http://x.com/", None)]
    captures = spark.createDataFrame([(i, u, day(d) if d else None) for i, u, d in urls], "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("kind", F.lit("clash"))
    got = {r["page_id"]: (r["blocked"], r["decided_by"], r["n_active"]) for r in url_filter.judge(captures, entries).collect()}
    assert got == {1: (False, None, 0), 2: (True, "spam", 1), 3: (False, None, 0), 4: (True, "spam", 1), 5: (False, "allow", 2), 6: (True, "malware", 3), 7: (False, None, 0), 8: (False, None, 0), 9: (False, None, 0), 10: (False, None, 0)}
    twice = captures.unionAll(captures).unionAll(captures.limit(1).withColumn("url", F.concat(F.lit("http://a.x.com/"), F.repeat(F.lit("p/"), 3000))).withColumn("page_id", F.lit(99).cast("long")).withColumn("fetched", F.to_date(F.lit(day(6)))))
    again = url_filter.judge(twice, entries).collect()
    assert len(again) in (11, 21) and {r["page_id"]: (r["blocked"], r["decided_by"], r["n_active"]) for r in again} == got | {99: (True, "spam", 1)}
    assert url_filter.judge(captures.limit(0), entries).count() == 0 and url_filter.judge(captures, entries.limit(0)).where("blocked").count() == 0


def _lines(rows, min_lines, min_words):
    seen, out = {}, {}
    lines = {d: t.split("\n") for d, t in rows}
    for n in {1, min_lines}:
        for d in sorted(lines):
            for p in range(len(lines[d]) - n + 1):
                seen.setdefault((n, *lines[d][p : p + n]), (d, p))
    for d, own in lines.items():
        gone = {q for n in {1, min_lines} for p in range(len(own) - n + 1) if seen[(n, *own[p : p + n])] != (d, p) and (n == min_lines or len(own[p].strip(" ").split(" ")) >= min_words) for q in range(p, p + n)}
        out[d] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_lines(spark, min_lines):
    r = random.Random(min_lines)
    pool = [_words(r.randint(1, 14), i, 50) for i in range(9)] + ["", " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(40)]
    got = {x["doc_id"]: x for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_lines, 8).collect()}
    want = _lines(rows, min_lines, 8)
    assert {d: x["text"] for d, x in got.items()} == want
    assert all(x["n_removed"] == sum(s["n"] for s in x["removed"]) for x in got.values())


def _longest_earlier(rows):
    lines = {d: t.split("\n") for d, t in rows}
    places = [(d, p) for d in sorted(lines) for p in range(len(lines[d]))]

    def common(x, y):
        n = 0
        while x[1] + n < len(lines[x[0]]) and y[1] + n < len(lines[y[0]]) and lines[x[0]][x[1] + n] == lines[y[0]][y[1] + n]:
            n += 1
        return n

    out = {}
    for i, x in enumerate(places):
        best = max(((common(x, y), -j) for j, y in enumerate(places[:i])), default=(0, 0))
        if best[0]:
            out[x] = (best[0], places[-best[1]])
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_longest_common_prefixes_of_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", hot)
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(1, 25)))) for i in range(14)]
    rows += [(20, "\n".join("xyzuvwpqrs")), (21, "\n".join("nxyzuvwpqrst")), (22, "\n".join("yzuvwpm")), (23, "a\n" * 40)]
    found = line_dedup.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x["doc"], x["pos"]): (x["n"], (x["source"]["doc"], x["source"]["pos"])) for x in found} == _longest_earlier(rows)


def test_a_thousand_equal_lines_are_one_maximal_run(spark):
    rows = [(1, "\n".join(["same"] * 1000)), (2, "head\n" + "\n".join(f"line {i}" for i in range(300))), (3, "\n".join(f"line {i}" for i in range(300)) + "\ntail")]
    found = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc"], x["pos"], x["n"], x["source"]["doc"], x["source"]["pos"]) for x in found) == [(1, 1, 999, 1, 0), (3, 0, 300, 2, 1)]


def test_documents_that_share_an_id_are_cut_apart(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (1, "x\ny\nz"), (2, "y\nz\na\nb\nc"), (2, "x\ny\nz")]
    got = sorted((x["doc_id"], x["text"], x["n_removed"]) for x in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "a\nb\nc\nd", 0), (1, "a\nb\nc\nd", 0), (1, "x\ny\nz", 0), (2, "", 3), (2, "y\nz", 3)]


def test_odd_lines(spark, odd, empty):
    got = line_dedup.dedup_lines(_clash(odd)).collect()
    assert len(got) == 12 and line_dedup.dedup_lines(empty).count() == 0
    by = collections.defaultdict(list)
    for x in got:
        by[x["doc_id"]].append(x["text"])
    assert by[1] == [None] and by[2] == [""] and by[None] == by[9][:1] == by[9][1:]


def test_archives(spark, tmp_path):
    big = "".join(chr(random.Random(7).randrange(32, 1000)) for _ in range(300_000))
    pages = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (3, "http://c\r\nX: y", ""), (4, "u", big), (None, "v", "same"), (6, "w", "other\r\n\r\nbody"), (2, "http://b", "same")]
    folder = f"file://{tmp_path}/w"
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("first", F.lit(1)).withColumn("payload", F.lit("clash"))
    warc.write_archives(df, folder).collect()
    for split in (64, 1000, 8 << 20):
        got = warc.read_archives(spark, folder, split).collect()
        assert len(got) == len(pages) and all(r["intact"] for r in got)
        kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
        assert kinds == collections.Counter([(5, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4), (9, "revisit", 3, 0), (3, "response", None, 0), (4, "response", None, len(big.encode())), (None, "revisit", 2, 4), (6, "response", None, 13)])
        assert next(bytes(r["payload"]).decode() for r in got if r["page_id"] == 4) == big
    empty = f"file://{tmp_path}/none"
    warc.write_archives(df.limit(0), empty).collect()
    assert warc.read_archives(spark, empty).count() == 0


def _classes(rows, similarity=0.8):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    bags = {}
    for d, t in rows:
        w = C.WORD.findall(low(t or ""))
        bags[d] = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    parent = {d: d for d in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        shared, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if total and shared >= similarity * total - 1e-9:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in bags}


def _mutated(text, n, seed):
    r, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [12, 1])
def test_near_classes(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    base = [_words(200, 100 + i) for i in range(6)]
    rows = [(10 * i + j, _mutated(b, j % 5, 1000 * i + j)) for i, b in enumerate(base) for j in range(9)]
    rows += [(900 + i, t) for i, t in enumerate([base[0], base[0], "", None, "two words", "two words", "TWO words", " ", "Is onhe. " * 30 + _words(12, 7), "Is onhe. " * 28 + _words(12, 8), "Is onhe. " * 29 + _words(3, 9), "Is onhe. " * 29 + _words(3, 10)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(_clash(docs)).collect()}
    assert got == _classes(rows)
    kept = {r["doc_id"] for r in near_dedup.keep_one(docs).collect()}
    assert kept == set(_classes(rows).values())


def test_rows_of_one_id_share_the_class_of_one_text(spark):
    a, b = _words(80, 300), _words(80, 301)
    got = near_dedup.near_classes(spark.createDataFrame([(5, a), (5, b), (3, a), (2, b), (9, "x")], "doc_id long, text string").repartition(3)).collect()
    by = {d: {r["class_id"] for r in got if r["doc_id"] == d} for d in (2, 3, 5, 9)}
    assert len(got) == 5 and by[9] == {9} and by[2] == {2} and by[3] == {3} and by[5] in ({2}, {3})


def test_recall_against_all_pairs(spark):
    import os

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    docs = C.table(spark, data, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs).collect()} == _classes(rows)


def test_odd_near_classes(spark, odd, empty):
    assert near_dedup.near_classes(empty).count() == 0
    got = near_dedup.near_classes(odd).collect()
    assert len(got) == 12 and {r["class_id"] for r in got if r["doc_id"] == 9} == {9} and {r["class_id"] for r in got if r["doc_id"] is None} == {None}


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 300).astype(np.uint64)
    wa, wb = r.integers(1, 9, 300), r.integers(1, 9, 300)
    sig = near_dedup.signatures(2, np.repeat([0, 1], 300), np.r_[h, h], np.r_[wa, wb], 4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 9] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {}
    for u, v in sorted(edges):
        want.setdefault(u, u)
        want[v] = want[u]
    assert got == want and components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def _contaminated(docs, items, n=10):
    split = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(0, len(w) - min(len(w), n) + 1) if w else 0):
            windows[tuple(w[k : k + min(len(w), n)])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for g, ids in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        out.append((d, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def test_decontamination_of_an_empty_table(spark, empty):
    items = spark.createDataFrame([(1, _words(12, 3))], "item_id long, text string")
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.decontaminate(empty, items).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination(spark, odd, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    passage = _words(25, 50)
    items = [(1, passage), (2, "Tiny item"), (3, ""), (4, None), (10, passage.upper()), (None, _words(12, 51)), (7, "one")]
    rows = [(d, t) for d, t, *_ in _odd_rows()] + [(20, f"x {passage.replace(' ', ', ')}! y"), (21, "a tiny ITEM. " * 3), (22, _words(12, 51)), (23, passage[: len(passage) // 3])]
    docs = _clash(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("w", F.lit(0)).withColumn("hits", F.lit(0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark).collect()
    key = lambda x: (x[0] is None, x[0] or 0)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(_contaminated(rows, items), key=key)
    clean = decontaminate.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()}.isdisjoint({4, 20, 21, 22})
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans").collect()}
    assert cut[20] == "x y" and cut[21] == "a a a " and cut[23] == passage[: len(passage) // 3] and cut[1] is None
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0


def _pipeline_input(spark, folder, rows, items):
    docs = spark.createDataFrame(rows, DOCS).withColumn("rejected", F.lit("kept")).withColumn("score", F.lit(1)).withColumn("n_removed", F.lit("x")).withColumn("_k", F.lit(2))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline(spark, tmp_path):
    """Each stage against a plain version, given what the stage before it kept: repeated rows, long texts, clashing columns."""
    rows, _ = _spoken(spark)
    r = random.Random(60)
    passage = " ".join(r.choice(["baka", "doko", "mana", "naka"]) + r.choice(["baka", "doko", "mana", "naka"]) for _ in range(30))
    rows = [(d, t, lang, s, len(t)) for d, t, lang, s, _ in rows]
    long = " ".join(t for _, t, *_ in rows[:150])
    rows += [(1000, rows[0][1], "aa", "s", 0), (1001, passage + " " + passage[:120].title(), "aa", "s", 0), (1002, None, None, None, None), (1003, "12 34", None, "s", 5), (1004, long, "aa", "s", 0), (1005, rows[7][1] + "\n" + rows[8][1] + "\n" + rows[9][1], "aa", "s", 0)]
    rows += [(1006, rows[11][1] + " baka naka mana", "aa", "s", 0), rows[5], rows[5], (None, rows[6][1] + " pfeil und", "bb", "s", 0)]
    items = [(1, passage), (2, None)]
    docs = _pipeline_input(spark, str(tmp_path), rows, items)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], str(tmp_path)))
        assert seen[-1].columns == docs.columns and seen[-1].where("rejected != 'kept' or score != 1 or n_removed != 'x' or _k != 2").count() == 0
    model = langid.fit(docs)
    right = lambda t: bool(t) and any(map(str.isalpha, t)) and model.scores([t]).max() >= model.threshold
    assert texts(seen[1]) == sorted(((d, t) for d, t, *_ in rows if right(t)), key=str)
    given = texts(seen[1])
    cut = _lines({d: t for d, t in given if d is not None}.items(), 3, 10)
    assert texts(seen[2]) == sorted(((d, t if d is None else cut[d]) for d, t in given if d is None or cut[d] != ""), key=str)
    given = texts(seen[2])
    classes = _classes([x for x in given if x[0] is not None])
    assert texts(seen[3]) == [(d, t) for d, t in given if d is None or classes[d] == d]
    given = texts(seen[3])
    dirty = {d for d, _, n, _ in _contaminated([x for x in given if x[0] is not None], items) if n}
    assert texts(seen[4]) == [(d, t) for d, t in given if d not in dirty] and dirty == {1001}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]) for r in packed if r["piece"] == 0)) == sorted(str(d) for d, _ in texts(seen[4]))
    assert len({r["sequence_id"] for r in packed}) == -(-sum(r["length"] for r in packed) // 4096)


def test_pipeline_of_an_empty_table_and_without_labels(spark, tmp_path):
    docs = _pipeline_input(spark, f"{tmp_path}/a", [], [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/a")
        assert docs.count() == 0 and len(docs.columns) == 9
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    rows = [(i, _words(60, 200 + i), None, "s", 0) for i in range(20)]
    docs = _pipeline_input(spark, f"{tmp_path}/b", rows, [(1, "zz yy")])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()} == set(range(20))


def test_queries_against_sql(spark):
    import os

    import duckdb

    from tessera import llm

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables here")
    sql = duckdb.connect()
    for f in os.listdir(data):
        sql.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    for name, statement in llm.oracle_sql().items():
        df = llm.queries()[name](spark, data)
        columns = sorted(df.columns)
        found = sql.execute(statement)
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert sorted(str([str(v) for v in r]) for r in df.select(*columns).collect()) == sorted(str([str(r[names.index(c)]) for c in columns]) for r in found.fetchall()), name
