"""Input columns of any name come back unchanged; languages and lines in any script."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, exact_dedup, langid, line_dedup, near_dedup

#: Names that the operators use on the way, and some that need quoting.
INNER = """_h _doc _hits _w _th _places _grams _true _runs _text_hash _rejected _score _lang_pred _n_lines _n_removed _removed _gone _row _key carried row key run digest check size best
h w n at gram hits doc pos line source_ band leader class_id id into from item_id lang_pred score rejected n_removed removed n_lines a.b K""".split() + ["with space"]


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("crowded"))
    r = random.Random(3)
    text = lambda: "\n".join(" ".join(r.choice("baka doko mana naka stri chten".split()) for _ in range(12)) for _ in range(4))
    rows = [(i, text(), "aa" if i % 2 else "bb", len("x")) for i in range(60)]
    passage = " ".join(f"secret{i}" for i in range(12))
    rows += [(100, rows[3][1], "aa", 1), (101, f"{passage} {text()}", "bb", 1), (102, rows[4][1] + "\n" + text(), "aa", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    for k, name in enumerate(INNER):
        docs = docs.withColumn(name, F.lit(f"own {k}"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, folder


def _unchanged(docs, out):
    assert out.columns == docs.columns
    found = out.collect()
    names = {n: i for i, n in enumerate(docs.columns)}
    assert found and all(r[names[n]] == f"own {k}" for r in found for k, n in enumerate(INNER))
    return {r[0] for r in found}


def test_every_stage_gives_back_the_columns_it_got(spark, crowded):
    docs, folder = crowded
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        kept = _unchanged(docs, out)
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert name != "decontamination" or 101 not in kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


def test_operators_give_back_the_columns_they_got(spark, crowded):
    docs, folder = crowded
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    for remove in ("documents", "spans"):
        _unchanged(docs, decontaminate.decontaminate(docs, items, remove=remove))
    _unchanged(docs, near_dedup.keep_one(docs))
    assert 100 not in _unchanged(docs, exact_dedup.drop_copies(docs))
    own = ("lines here", "lines gone", "which")
    cut = line_dedup.dedup_lines(docs, names=own)
    assert cut.columns == [*docs.columns, *own]
    _unchanged(docs, cut.drop(*own))
    named = langid.identify(docs, langid.fit(docs), ("spoken", "how sure", "out"))
    _unchanged(docs, named.drop("spoken", "how sure", "out"))


def _speech(stems, n, seed, first=0):
    r = random.Random(seed)
    return [(first + i, " ".join(r.choice(stems) + r.choice(stems) for _ in range(r.randint(5, 60)))) for i in range(n)]


def test_two_languages_can_reject_a_third(spark):
    known = {"aa": ["baka", "doko", "mana", "naka"], "bb": ["stri", "chten", "pfeil", "und"]}
    rows = [(*r, k) for i, (k, stems) in enumerate(known.items()) for r in _speech(stems, 600, i, 1000 * i)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    other = spark.createDataFrame(_speech(["ció", "que", "ente", "los"], 200, 9), "doc_id long, text string")
    assert langid.identify(other, model).where("rejected").count() > 150
    clean = langid.identify(docs.where("crc32(cast(doc_id as string)) % 4 = 2"), model)
    assert clean.where("rejected").count() <= 0.02 * clean.count()


def test_a_rare_language_is_in_the_sample(spark):
    docs = spark.range(60_000).selectExpr("id as doc_id", "'x' as text", "case when id % 6000 = 7 then 'zz' when id % 3 = 0 then 'bb' else 'aa' end as lang")
    got = {r["lang"]: r["count"] for r in langid._sample(docs, langid.TRAIN_ROWS).groupBy("lang").count().collect()}
    assert got["zz"] == 10 and 1000 < got["bb"] < got["aa"] and 2200 < sum(got.values()) <= 3150


def test_long_lines_are_told_in_any_script(spark):
    words = [f"w{i}" for i in range(10)]
    long = ["\t".join(words), "\u00a0".join(words), "\u3000".join(words), "数据去重要看整行是否重复而不是只看空格分开的词语所以这里有很长一行", "ข้อความภาษาไทยไม่มีช่องว่างระหว่างคำจึงต้องนับตัวอักษรแทน"]
    short = ["| a |         | b |", "1          2", "-" * 80, "短い行です", "w0  w1\t\tw2"]
    rows = [(d, f"own {d}\n{line}\nend {d}") for i, line in enumerate(long + short) for d in (2 * i, 2 * i + 1)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * i + k: int(k and i < len(long)) for i in range(len(long + short)) for k in (0, 1)}
