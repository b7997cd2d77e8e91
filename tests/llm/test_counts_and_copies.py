"""Collocations, the digest tree and token alignment against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, exact_dedup, token_alignment

DOCS = "doc_id long, text string, lang string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _clash(df):
    for c in ("row", "id", "run", "digest", "check", "size", "best", "n", "words", "w1", "salt", "a", "b", "held", "KEPT", "text.x"):
        df = df.withColumn(c, F.lit("x"))
    return df


def _rows(seed=0, n=120):
    r = random.Random(seed)
    vocabulary = ["New", "york", "CITY", "é", "École", "漢字", "of", "the", "a-b", "x\x0by", "", "\x1c"]
    texts = [None, "", " ", ".", "Same Text", "same text", "SAME TEXT", "École", "école", "word " * 3000, "a\tb  c.d"]
    texts += ["".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "! "]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    rows = [(i, t, [None, "en", "fr", "und"][i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[20], (None, "same text", "en"), (None, "Alone here", "fr"), (None, None, None)]


def _phrases(rows, least, top, order=4):
    """The definition, word for word."""
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(ASCII_LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, order + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    over = collections.Counter()
    for (lang, g), a in candidates.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                over[lang, g[i : i + k]] = max(over[lang, g[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, g), a in candidates.items():
        if (lang, g) in over and 100 * over[lang, g] >= 80 * a:
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), l, r))
    return {(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize(("least", "top", "bits"), [(2, 2000, 20), (3, 5, 20), (5, 40, 16)])
def test_collocations(spark, least, top, bits):
    rows = _rows()
    got = collocations.collocations(_clash(spark.createDataFrame(rows, DOCS).repartition(3)), least, top, bits=bits).collect()
    assert len(got) > 5 and {tuple(r) for r in got} == _phrases(rows, least, top) and len(set(got)) == len(got)


def test_full_buckets_cut_nothing(spark):
    """With two to the power of 15 buckets most are full; results stay the same."""
    r = random.Random(4)
    rows = [(i, " ".join(f"w{min(r.randrange(9000), r.randrange(9000))}" for _ in range(900)), "en") for i in range(60)]
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), 3, 2000, bits=15).collect()
    assert {tuple(x) for x in got} == _phrases(rows, 3, 2000)


def test_collocations_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "en")]):
        assert collocations.collocations(spark.createDataFrame(rows, DOCS)).collect() == []


def test_words_that_share_a_code_get_another_seed(spark, monkeypatch):
    whole = collocations.vocabulary
    monkeypatch.setattr(collocations, "vocabulary", lambda docs, seed: whole(docs, seed).withColumn("code", F.col("code") if seed > 1 else F.lit(7).cast("long")))
    rows = _rows(3, 20)
    docs = spark.createDataFrame(rows, DOCS)
    assert collocations.exact_vocabulary(docs.select("text", "lang"))[1] == 2
    assert {tuple(r) for r in collocations.collocations(docs, 2).collect()} == _phrases(rows, 2, 2000)


def _copies(rows, largest):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(ASCII_LOWER)].append(d)
    return {t: ((max if largest else min)([x for x in ids if x is not None], default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize(("keep", "fan_bits", "digest_bits", "parts"), [("largest", 4, 64, 3), ("smallest", 1, 64, 9), ("largest", 1, 2, 5), ("smallest", 2, 1, 20)])
def test_digest_tree(spark, keep, fan_bits, digest_bits, parts):
    rows = _rows(1)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(hashlib.sha256((t or "").translate(ASCII_LOWER).encode()).hexdigest(), (t or "").translate(ASCII_LOWER))
    want = _copies(rows, keep == "largest")
    got = exact_dedup.exact_groups(_clash(spark.createDataFrame(rows, DOCS).repartition(parts)), keep, fan_bits, digest_bits).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(x[0]) for x in rows)
    kept = collections.Counter()
    for r in got:
        assert (r["keep_id"], r["group_size"]) == want[texts[r["text_sha256"]]]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(want)


def test_dropped_copies(spark):
    rows = _rows(2)
    docs = _clash(spark.createDataFrame(rows, DOCS).repartition(4))
    got = exact_dedup.drop_copies(docs, "smallest", 1)
    assert got.dtypes == docs.dtypes
    found = got.collect()
    want = _copies(rows, False)
    assert len(found) == len(want) and {(r["text"] or "").translate(ASCII_LOWER): r["doc_id"] for r in found} == {t: d for t, (d, _) in want.items()}
    assert all(r["row"] == r["digest"] == "x" for r in found)


def test_copies_of_nothing_and_of_one_text(spark):
    assert exact_dedup.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
    many = spark.range(0, 3000, 1, 20).select(F.col("id").alias("doc_id"), F.lit("One Text").alias("text"))
    got = exact_dedup.exact_groups(many, "largest", 2)
    assert got.agg(F.min("keep_id"), F.max("keep_id"), F.min("group_size"), F.sum(F.col("kept").cast("int"))).first() == (2999, 2999, 3000, 1)
    # Past the first level a text counts one row a run, however many copies there are.
    runs = exact_dedup.digest_runs(many.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("id"), "text"))
    assert exact_dedup.tree_merge(runs, "largest", 2).count() == 20


def _paths():
    P = pytest.importorskip("public_tokenizers")
    return P.path(token_alignment.TOKENIZER_A), P.path(token_alignment.TOKENIZER_B)


def _aligned(rows):
    """Every pair of tokens compared by their byte ranges; texts encoded whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = _paths()
    a, b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x < 127 or 161 <= x < 173 or x > 173]
    other = [x for x in range(256) if x not in plain]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}
    out, held = [], collections.Counter()
    for d, text in rows:
        links, groups, ends = [], "", None
        if text:
            ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            ba = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
            bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
            if b"".join(ba) == b"".join(bb) == f" {text}".encode():
                ends = []
                for parts in (ba, bb):
                    at = 0
                    ends.append([at := at + len(x) for x in parts])
                spans = [[(e - len(x), e) for e, x in zip(es, parts)] for es, parts in zip(ends, (ba, bb))]
                links = [(x, y) for x, (s, e) in zip(ia, spans[0]) for y, (t, u) in zip(ib, spans[1]) if s < u and t < e]
                cuts, parts, last = sorted(set(ends[0]) & set(ends[1])), [], 0
                for c in cuts:
                    parts.append("|".join(",".join(str(i) for i, e in zip(ids, es) if last < e <= c) for ids, es in zip((ia, ib), ends)))
                    last = c
                groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
                out.append([d, len(ia), len(ib), len(cuts), len(links), links, groups])
        if ends is None:
            out.append([d, 0, 0, 0, 0, [], ""])
        held.update(set(links))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted((str(d), na, nb, ng, nl, sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), g) for d, na, nb, ng, nl, links, g in out)


def _texts():
    r = random.Random(7)
    odd = ["a", " ", "   ", "a ", "a  ", " a", "a \n", "\n", "\n\nb", "a\n b\n\n  c", "tab\tand\u000bmore", "　wide　space", "no break", "x\u0085y", "!\x1c!", "▁x", "a▁b", "<|endoftext|> <s>", "\x00a", "ｆｕｌｌ １", "é é", "漢字かな", "🙂🙃 ok", "don't we'll", "a​b", "x" * 500, "word " * 400, "\r\n" * 3 + "z", "a b c᠎d", "١٢٣ 45"]
    pieces = [*odd, *"abcdefghij é ü the of and ing tion".split(), "\n", " ", "  "]
    return [None, "", *odd, *("".join(r.choice(pieces)[:12] + r.choice(["", " ", " ", "\n"]) for _ in range(r.randint(1, 25))) for _ in range(80))]


@pytest.mark.parametrize(("broadcast_pairs", "remembered"), [(1_000_000, 400_000), (0, 3)])
def test_alignment(spark, monkeypatch, broadcast_pairs, remembered):
    monkeypatch.setattr(token_alignment.PairedIds.__init__, "__defaults__", (remembered,))
    rows = [(i, t) for i, t in enumerate(_texts())]
    rows += [rows[5], rows[40], (None, "the end"), (None, None)]
    got = token_alignment.alignment(_clash(spark.createDataFrame([(d, t, "en") for d, t in rows], DOCS).repartition(2)), *_paths(), broadcast_pairs).collect()
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got) == _aligned(rows)


def test_words_have_the_ids_of_their_texts():
    """Encoding by remembered words, in small memory and in large, against encoding whole texts."""
    texts = _texts()
    for remembered in (1, 400_000):
        encoder = token_alignment.PairedIds(*_paths(), remembered)
        for at in range(0, len(texts), 9):
            own = texts[at : at + 9]
            right, ids, bounds = encoder.encode(own)
            for i, t in enumerate(own):
                for side, x, b in zip(encoder.sides, ids, bounds):
                    whole = side.encode([f" {t}"])[0] if t else []
                    assert x[b[i] : b[i + 1]].tolist() == (whole if right[i] else []), repr(t)
                if t and "▁" not in t:
                    assert right[i], repr(t)


def test_alignment_of_nothing(spark):
    assert token_alignment.alignment(spark.createDataFrame([], DOCS), *_paths()).collect() == []


def test_alignment_takes_little_at_once(spark):
    """Every row of a large batch once, in batches of 1 MB of text at most: two workers and a full heap have to fit an executor."""
    pa = pytest.importorskip("pyarrow")

    class Docs:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [None, "", "the end"] + [f"some words of {i} " * (1 + i % 90) for i in range(3500)]
    size = dict(enumerate(len((t or "").encode()) for t in texts))
    assert sum(size.values()) > 2 << 20
    batch = pa.RecordBatch.from_pydict({"row": list(size), "doc_id": [7 * i for i in size], "text": texts})
    out = list(token_alignment.aligned(Docs(), *_paths())(iter([batch])))
    assert all(sum(size[r] for r in b.column("row").to_pylist()) <= 1 << 20 for b in out)
    assert sorted((r, d) for b in out for r, d in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist())) == [(i, 7 * i) for i in size]
