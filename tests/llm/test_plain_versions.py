"""Shards and languages against plain versions that share none of the operators' code."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import langid, sharding


def test_every_row_has_the_place_of_the_whole_sorted_list(spark):
    r = random.Random(8)
    rows = [(i, f"text {r.randrange(900)}" if i % 11 else None, r.choice(["a", "a", "a", "b", "c", None])) for i in range(1100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    text = F.coalesce("text", F.lit(""))
    order = docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), "doc_id", F.crc32(F.encode(text, "UTF-8")), (F.octet_length(text) + 1).cast("long"), F.lit(0).cast("long")).alias("h")).collect()
    # Buckets go by the hash read without a sign; rows of a bucket by its value.
    bits = max(0, math.ceil(math.log2(len(rows) / max(64, math.sqrt(len(rows))))))
    groups = {}
    for x in order:
        groups.setdefault(x["source"], []).append(((x["h"] % (1 << 64)) >> (64 - bits), x["h"], x["doc_id"]))
    placed = []
    for source, own in groups.items():
        label = "-" if source is None else f"+{source}"
        for rank, (_, h, d) in enumerate(sorted(own)):
            placed.append(((rank + 0.5) / len(own), label, h, d))
    want, n = {}, len(rows)
    for p, (*_, d) in enumerate(sorted(placed)):
        shard = p * 8 // n
        want[d] = (shard, p - -(-shard * n // 8))
    assert {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.shard_documents(docs).collect()} == want


def _bucket(gram):
    h = len(gram)
    for c in gram:
        h = ((h ^ c) * 16777619) % (1 << 32)
    h ^= h >> 15
    return (h * 0x2C1B3C6D) % (1 << 32) >> (32 - (langid.BUCKETS.bit_length() - 1))


def _score(model, text):
    """One text, one n-gram at a time: bytes of the lower-cased text between spaces, letters and bytes beyond ASCII as they are, all else a space."""
    raw = b"    " + text.lower().encode() + b"    "
    data = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw) + b"    "
    logits = np.zeros(len(model.labels))
    for n in (2, 3, 4):
        for i in range(len(raw)):
            logits += model.table[:, _bucket(data[i : i + n])].astype(np.float64)
    z = (logits / (3 * len(raw)) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    return p / p.sum()


def test_languages_and_scores_are_those_of_a_plain_forward_pass(spark):
    r = random.Random(1)
    stems = {"aa": ["baka", "doko", "mana", "naka"], "bb": ["stri", "chten", "pfeil", "Und"], "cc": ["ció", "que", "ente", "los"]}
    rows = [(i, " ".join(r.choice(stems[k]) + r.choice(stems[k]) for _ in range(r.randint(1, 40))), k) for i in range(240) for k in [r.choice(sorted(stems))]]
    docs = spark.createDataFrame([*rows, (900, "漢字 Ünd 12!", None), (901, None, None), (902, "12 !?", "aa")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = {d: t for d, t, _ in rows} | {900: "漢字 Ünd 12!"}
    for x in langid.identify(docs.repartition(4), model).collect():
        if x["doc_id"] in (901, 902):
            assert (x["lang_pred"], x["score"]) == ("und", 0.0)
            continue
        p = _score(model, texts[x["doc_id"]])
        assert x["lang_pred"] == model.labels[int(p.argmax())] and abs(x["score"] - p.max()) < 1e-6
        assert x["rejected"] == (round(float(p.max()), 9) < model.threshold)
