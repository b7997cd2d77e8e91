"""Line dedup: repeated runs of lines by a suffix array over line ids, made by distributed prefix doubling.

Each document is a sequence of line ids (128-bit hashes of the lines). Doubling names every suffix by its first 1, 2, 4 ..
lines: the name of 2k lines at a place is made of the names of k lines there and k places on, one self-join on the place per
round. Suffixes of one name are an interval of the suffix array; a suffix whose name occurs once leaves, and rounds go on until all
names are unique, so they number the logarithm of the longest repeated run.

An interval of 2^k lines holds suffixes that part company somewhere before 2^(k+1). Halving steps, each the reverse of a doubling round, find
where: the names of 2^s lines behind the common prefix split an interval into deeper ones. A suffix ends in the deepest interval that it
does not lead, whose depth is its longest common prefix with any earlier suffix, and whose leader is where that one stands. A deeper interval
leaves its leader alone behind in the shallower one, so each suffix is in two intervals at most, as one that is asked about
and as a leader, whatever the depth. A suffix whose predecessor matches one line more is a tail of that match; the others start the maximal repeated runs.

A later copy is deleted where the run has `min_lines` lines, or where one line alone has `min_words` words, i.e. runs of no white space, or
`CHARS_PER_WORD` times as many characters of scripts that are written without spaces. Earlier means
smaller doc_id, or the same document and an earlier line.

Names that more than a 4096th of all repeated lines share are at most 4096, and meet their suffixes by a broadcast; all others by equi-joins that no
key can overfill. The leader of a name is an aggregate with map-side combining. Every round is written out.

Defined cases: null text has no lines and stays null; an empty text is one empty line, and is kept. Rows without a
doc_id are left as they are and copy nothing. Rows that repeat a doc_id and its text count once: they are cut alike, and are no copies of
each other; rows that share a doc_id alone are documents of their own, in order of a hash of their text. A document may lose all its lines: its text is then empty.
An empty table gives an empty result. Extra columns of whatever name are kept by `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

MIN_LINES = 3
MIN_WORDS = 10
CHARS_PER_WORD = 3
#: White space by code points, as engines differ in what they count to it; a word is a run of anything else.
SPACES = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LATIN_SPACES = r"\x{09}\x{0A}\x{0B}\x{0C}\x{0D}\x{20}\x{85}\x{A0}"
WORD = f"[^{SPACES}]+"
UNSPACED = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"

#: A name that this share of all repeated lines has is looked up by a broadcast: there are at most so many.
HOT_SHARE = 4096
#: .. unless it has fewer suffixes than this, which any task holds.
HOT_LEAST = 1000

_PLACE = ("doc", "text_hash", "pos")


def _name(*parts) -> list:
    return [F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b")]


def _place() -> Column:
    return F.struct(*_PLACE)


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str], hot_from: int | None, found: str, how: str = "inner") -> DataFrame:
    """rows with the column `found` of the group of their keys; groups (keys, c of how many rows each has, found). how: inner, or left to keep the rest with null.

    hot_from: rows from which a group is hot, null where none is. Hot groups, of which there are at most HOT_SHARE, are looked up by a broadcast, and
    their rows then go through the join with the others under keys of their own, so that no task is overfilled.
    """
    if hot_from is None:
        return rows.join(groups.drop("c"), keys, how)
    hot = groups.where(F.col("c") >= hot_from).select(*keys, F.col(found).alias("_hot"))
    near = rows.join(F.broadcast(hot), keys, "left")
    near = near.withColumn("_k", F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(F.xxhash64(*_PLACE)))
    cold = groups.where(F.col("c") < hot_from).select(F.col(keys[0]).alias("_k"), *keys[1:], found)
    both = near.join(cold, ["_k", *keys[1:]], "left").withColumn(found, F.coalesce("_hot", found))
    return (both if how == "left" else both.where(F.col(found).isNotNull())).select(*rows.columns, found)


def _leaders(suffixes: DataFrame) -> DataFrame:
    """(a, b, c, least): the names that more than one place has, how many suffixes have each, and the earliest."""
    return suffixes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(_place()).alias("least"), F.max(_place()).alias("_most")).where("least != _most").drop("_most")


# Lengths are columns rather than numbers in the plans of rounds, so that all rounds share their compiled code.


def _doubled(level: DataFrame) -> DataFrame:
    """(place, a, b, size): names of the run of `size` lines at each place joined to the run that follows it."""
    x = level.select(*_PLACE, "a", "b", "size")
    y = level.select("doc", "text_hash", (F.col("pos") - F.col("size")).alias("pos"), F.col("a").alias("c"), F.col("b").alias("d"))
    return x.join(y, list(_PLACE)).select(*_PLACE, *_name("a", "b", "c", "d"), (F.col("size") * 2).alias("size"))


def _deeper(asked: DataFrame, level: DataFrame, hot_from: int | None, rows: int) -> DataFrame:
    """One halving: suffixes (place, depth, a, b, own, least) of intervals, split by the names of a level's `size` lines behind their depth.

    own marks suffixes that are asked about; each interval has one more, its leader.
    """
    behind = level.select("doc", "text_hash", F.col("pos").alias("_at"), F.col("a").alias("qa"), F.col("b").alias("qb"), "size")
    named = asked.withColumn("_at", F.col("pos") + F.col("depth")).join(behind, ["doc", "text_hash", "_at"], "left").drop("_at")
    named = C.few(named, rows)
    keys = ["a", "b", "qa", "qb"]
    parts = named.where("qa is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min(_place()).alias("first")).where("c > 1")
    split = _meet(named, parts, keys, hot_from, "first", "left")
    leads = F.expr("doc = first.doc and text_hash = first.text_hash and pos = first.pos")
    names = ("depth", "a", "b", "own", "least")
    here = F.struct(*names)
    a, b = _name("a", "b", "qa", "qb")
    deep = F.struct((F.col("depth") + F.col("size")).alias("depth"), a, b, (F.col("own") & ~leads).alias("own"), F.col("first").alias("least"))
    # What is alone behind the depth stays where it is; the leader of a part does so too, and leads the part as well.
    ways = F.when(F.col("first").isNull(), F.array(here)).when(leads, F.array(here, deep)).otherwise(F.array(deep))
    return split.select(*_PLACE, F.explode(ways).alias("_x")).select(*_PLACE, *(F.col(f"_x.{n}").alias(n) for n in names))


def _lines(docs: DataFrame) -> DataFrame:
    """(place, a, b, line): every line of documents with an id."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return own.select(*_PLACE, *_name("line"), "line")


def counts_alone(line: Column, min_words: int) -> Column:
    """Whether a line has `min_words` words, or so many characters of scripts written without spaces."""
    several = lambda spaces: F.regexp_like(line, F.lit(f"(?:[^{spaces}]++[{spaces}]++){{{min_words - 1}}}[^{spaces}]"))
    # Most lines have no other white space than Latin-1's, which Java tells apart by a bitmap.
    words = F.when(F.regexp_like(line, F.lit(r"[^\x{00}-\x{FF}]")), several(SPACES)).otherwise(several(LATIN_SPACES))
    unspaced = UNSPACED.replace("p{", "p{Is")
    signs = F.regexp_like(line, F.lit(f"(?:{unspaced.replace('[', '[^', 1)}*+{unspaced}){{{CHARS_PER_WORD * min_words}}}"))
    # Those scripts' characters take three bytes or more, and telling scripts apart takes long.
    wide = F.octet_length(line) - F.length(line) >= 2 * CHARS_PER_WORD * min_words
    return F.when(F.length(line) >= 2 * min_words - 1, words | F.when(wide, signs).otherwise(False)).otherwise(False)


def matches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, pos, n, source, alone): how many lines from each place also stand at an earlier place, and the least such place for so many; n > 0."""
    lines = _lines(docs)
    names = lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min(_place()).alias("least"), F.max(_place()).alias("_most"), F.max(counts_alone(F.col("line"), min_words)).alias("alone"))
    names = C.written(names.where("least != _most").select("a", "b", "c", F.struct("least", "alone").alias("name")))
    total, most = names.agg(F.sum("c"), F.max("c")).first()
    hot_from = max(HOT_LEAST, (total or 0) // HOT_SHARE)
    if (most or 0) < hot_from:  # nor is any longer name, which no more suffixes have
        hot_from = None
    level = _meet(lines.drop("line"), names, ["a", "b"], hot_from, "name").select(*_PLACE, "a", "b", "name.*", F.lit(1).alias("size"))
    rows = total or 0
    level = C.written(C.few(level.distinct(), rows))  # repeated rows
    alone = level.select(*_PLACE, "alone")
    levels = [level.drop("alone")]
    while n := levels[-1].count():
        doubled = C.few(_doubled(levels[-1]), n)
        levels.append(C.written(C.few(_meet(doubled, _leaders(doubled), ["a", "b"], hot_from, "least"), n)))
    # Asked about at a level: suffixes that do not lead its name, but lead or have no name of the next.
    not_least = F.expr("not (doc <=> least.doc and text_hash <=> least.text_hash and pos <=> least.pos)")
    asked = None
    for k in range(len(levels) - 2, -1, -1):
        deeper = levels[k + 1].where(not_least).select(*_PLACE)
        mine = levels[k].where(not_least).join(deeper, list(_PLACE), "left_anti").select(*_PLACE, F.col("size").alias("depth"), "a", "b", F.lit(True).alias("own"), "least")
        mine = C.few(mine, rows)
        leaders = C.few(mine.select("least.*", "depth", "a", "b", "least").distinct(), rows).withColumn("own", F.lit(False))
        fresh = mine.unionByName(leaders)
        asked = fresh if asked is None else asked.unionByName(fresh)
        if k:
            asked = C.written(C.few(_deeper(asked, levels[k - 1], hot_from, rows), rows))
    if asked is None:
        return alone.limit(0).select(*_PLACE, F.lit(0).alias("n"), _place().alias("source"), "alone")
    return asked.where("own").select(*_PLACE, F.col("depth").alias("n"), F.col("least").alias("source")).join(alone, list(_PLACE))


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, text_hash, pos, n, source): maximal runs of n >= min_lines lines from line pos (from 0) that also stand at an earlier place, and lone lines that count.

    Runs of a document may overlap where they continue different places.
    """
    found = matches(docs, min_words)
    before = F.lag(F.struct("pos", "n")).over(Window.partitionBy("doc", "text_hash").orderBy("pos"))
    runs = found.where(F.col("n") >= min_lines).withColumn("_before", before).where("_before is null or _before.pos != pos - 1 or _before.n != n + 1").drop("_before", "alone")
    lone = found.where((F.col("n") < min_lines) & F.col("alone")).select("doc", "text_hash", "pos", F.lit(1).alias("n"), "source")
    return runs.unionByName(lone)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, names: tuple[str, str, str] = ("n_lines", "n_removed", "removed")) -> DataFrame:
    """docs with text cut, how many lines it had, how many are gone, and which (runs of start, n lines, as far as they go). Columns of docs of these names are replaced."""
    columns = [c for c in docs.columns if c not in names]
    kept = C.carried(docs.drop(*names), "doc_id", "text")
    runs = repeated_lines(docs, min_lines, min_words).groupBy(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash")).agg(F.collect_set(F.struct("pos", "n")).alias("_runs"))
    both = kept.join(runs, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_text_hash")), "left").drop("_doc", "_text_hash")
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType())])))])

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts, totals, gone, removed = [], [], [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("_runs").to_pylist()):
                lines = text.split("\n") if text is not None else []
                merged: list[list[int]] = []
                for s, n in sorted((r["pos"], r["n"]) for r in runs or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s + n)
                    elif s < len(lines):
                        merged.append([s, s + n])
                out, at = [], 0
                for s, e in merged:
                    out += lines[at:s]
                    at = e
                out += lines[at:]
                texts.append(None if text is None else "\n".join(out))
                totals.append(len(lines)), gone.append(len(lines) - len(out))
                removed.append([{"start": s, "n": min(e, len(lines)) - s} for s, e in merged])
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != "_runs"]
            own = [n for n in batch.schema.names if n != "_runs"]
            span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span)], names=[*own, *names])

    done = both.mapInArrow(cut, schema)
    return done.select(*C.restored(done, columns, "doc_id", "text"), *names)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
