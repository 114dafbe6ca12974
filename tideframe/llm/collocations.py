"""Phrase collocations of each language, counted exactly.

A dictionary gives each frequent word of a language an id. Pieces of text are broken at all other words, and runs of ids are
packed into binary keys of one width for each phrase length. Each task sorts and counts the keys of a block of text; the
partial counts are range-partitioned by the keys' mixed values, radix-sorted and counted by run length. A longer phrase is
packed only where all phrases inside it that were counted before are frequent, which loses none: a phrase is never more
frequent than its parts. The broadcast filter that tells frequent phrases is of a bounded size (idfilter.MOST_BITS); what it
lets pass too much is counted and found rare.

Tasks tell words by 64-bit codes, checked to be one to one over all words of the corpus. Up to BROADCAST_WORDS frequent words
travel as a sorted row of codes, and a word's id of four bytes is its place there. A larger dictionary stays a table: a filter
of bounded size tells frequent words, and the code of eight bytes is the id. Counts and candidates are tables in any case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import LOWER, U, Words, mix, seeds, text_slices, tidy
from .idfilter import id_filter, may_hold
from .scratch import Scratch
from .skew import join_by_key

#: Bytes that end a piece, and those that part words: the former, space and tab.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD_END = PIECE_END.copy()
WORD_END[[0x20, 0x09]] = True
#: Text bytes that are split into words at once, and words whose phrases are sorted and counted at once.
SLICE_BYTES, BLOCK_WORDS = 1 << 20, 1 << 20
#: Distinct words a task holds before it passes their counts on.
HELD_WORDS = 1 << 17
#: Frequent words that are broadcast as codes at most (32 MB), and bytes of an id up to and beyond that.
BROADCAST_WORDS, SHORT, LONG = 1 << 22, 4, 8


def _language_code(lang: str | None, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


def _coded(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, np.ndarray, np.ndarray]]:
    """Words of runs of a batch's texts, each word's code and the number of its piece (rising, pieces of one document apart)."""
    langs = batch.column("lang").to_pylist()
    known = {x: _language_code(x, seed) for x in set(langs)}
    of_doc = np.array([known[x] for x in langs], dtype=U)
    byte_code = seeds(256, 7 + seed)
    for lo, hi, data, offsets in text_slices(batch.column("text"), SLICE_BYTES):
        words = Words(data, offsets, WORD_END)
        code = mix(words.hashed(byte_code) ^ of_doc[lo:hi][words.doc])
        piece = np.cumsum(PIECE_END[data], dtype=np.int64)[words.start] if len(words.start) else np.zeros(0, np.int64)
        yield words, code, piece + words.doc


def _runs(order: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each run of equal rows along an order, and the runs' lengths."""
    change = np.zeros(len(order), bool)
    change[:1] = True
    for x in columns:
        y = x[order]
        change[1:] |= y[1:] != y[:-1]
    at = np.flatnonzero(change)
    return order[at], np.diff(np.append(at, len(order)))


WORD_ROWS = "code long, lang string, word string, a long"


def _word_counts(seed: int):
    """Counts of the distinct words of blocks. Equal codes of different words stay apart, told by a second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        check = seeds(256, 1009 + seed)

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by(["code", "lang", "word"]).aggregate([("a", "sum")])
            return table.rename_columns([*table.column_names[:-1], "a"]).select(["code", "lang", "word", "a"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            lo = 0
            for words, code, _ in _coded(batch, seed):
                first, count = _runs(np.argsort(code), [code, words.hashed(check)])
                low = LOWER[words.data].tobytes()
                spelled = [low[a:b].decode("utf-8", "replace") for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
                held.append(pa.table({"code": code[first].view(np.int64), "lang": pa.array(langs[lo + words.doc[first]], pa.string()), "word": pa.array(spelled, pa.string()), "a": count.astype(np.int64)}))
                lo += len(words.counts)
                if sum(len(x) for x in held) >= 4 * HELD_WORDS:
                    held = [merged()]
                    if len(held[0]) >= HELD_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return run


def _mixed(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A mixed value of each run of `size` codes."""
    h = codes[starts]
    for j in range(1, size):
        h = mix(h * U(0x9E3779B97F4A7C15) + codes[starts + j])
    return h


@dataclass
class Ids:
    """How a task tells frequent words: by their sorted codes, whose places are the ids, or by a filter of the codes that are
    the ids themselves."""

    bytes: int
    shared: Broadcast

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each code's id, and whether its word may be frequent (with a sorted row: whether it is)."""
        table = self.shared.value
        if self.bytes == LONG:
            return codes, may_hold(table, codes.view(np.int64))
        at = np.minimum(np.searchsorted(table, codes), max(0, len(table) - 1))
        return at.astype(U), table[at] == codes if len(table) else np.zeros(len(codes), bool)


def numbered(known: DataFrame) -> tuple[DataFrame, Ids]:
    """The dictionary (code, ...) with key, the id's bytes, big end first; and what tasks need to give words their ids."""
    size = known.count()
    if size > BROADCAST_WORDS:
        return known.withColumn("key", F.unhex(F.lpad(F.hex("code"), 2 * LONG, "0"))), Ids(LONG, id_filter(known, "code").shared)
    codes = known.select("code").toPandas()["code"].to_numpy(np.int64).view(U)
    ids = Ids(SHORT, known.sparkSession.sparkContext.broadcast(np.sort(codes)))

    @F.pandas_udf("long")
    def place(code: pd.Series) -> pd.Series:
        return pd.Series(ids.of(code.to_numpy(np.int64).view(U))[0].view(np.int64))

    return known.withColumn("key", F.unhex(F.lpad(F.hex(place("code")), 2 * SHORT, "0"))), ids


def _keys(codes: np.ndarray, starts: np.ndarray, size: int, width: int) -> pa.Array:
    """Runs of ids as binary keys, big end first."""
    wide = np.empty((len(starts), size), f">u{width}")
    for j in range(size):
        wide[:, j] = codes[starts + j]
    offsets = np.arange(len(starts) + 1, dtype=np.int32) * np.int32(size * width)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(wide.tobytes())])


PARTIAL_ROWS, GRAM_ROWS = "key binary, a int", "h long, key binary, a long"


def _gram_counts(sizes: list[int], ids: Ids, part: int, part_shared, seed: int):
    """Counts of phrases of some sizes in blocks of text. Where part > 1, all phrases of that size inside must be in a filter."""

    def count(codes: np.ndarray, pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, frequent = ids.of(codes)
        # joined[i]: words i to i + part - 1 are frequent, of one piece, and in the filter
        joined = frequent[: max(0, len(codes) - part + 1)].copy()
        for j in range(1, part):
            joined &= frequent[j : len(joined) + j] & (pieces[j : len(joined) + j] == pieces[: len(joined)])
        if part > 1:
            at = np.flatnonzero(joined)
            joined[at] = may_hold(part_shared.value, _mixed(codes, at, part).view(np.int64))
        for size in sizes:
            whole = joined[: max(0, len(codes) - size + 1)].copy()
            for j in range(1, size - part + 1):
                whole &= joined[j : len(whole) + j]
            starts = np.flatnonzero(whole)
            starts = starts[pieces[starts] == pieces[starts + size - 1]]
            h = _mixed(codes, starts, size)
            first, n = _runs(np.argsort(h), [h, *[codes[starts + j] for j in range(size)]])
            for a in range(0, len(first), 1 << 17):
                some = first[a : a + (1 << 17)]
                yield pa.record_batch({"key": _keys(codes, starts[some], size, ids.bytes), "a": n[a : a + (1 << 17)].astype(np.int32)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, pieces, held, last = [], [], 0, 0
        for batch in batches:
            for _, code, piece in _coded(batch, seed):
                if not len(code):
                    continue
                codes.append(code)
                pieces.append((piece + (last + 1)).astype(np.int32))
                held, last = held + len(code), int(pieces[-1][-1])
                if held >= BLOCK_WORDS:
                    yield from count(np.concatenate(codes), np.concatenate(pieces))
                    codes, pieces, held, last = [], [], 0, 0
        if held:
            yield from count(np.concatenate(codes), np.concatenate(pieces))

    return run


def _mixed_keys(keys: pa.ChunkedArray, width: int) -> np.ndarray:
    """_mixed of binary keys of any lengths."""
    out = np.zeros(len(keys), U)
    sizes = pc.binary_length(keys).to_numpy() // width
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        codes = np.frombuffer(b"".join(keys.take(pa.array(at)).to_pylist()), f">u{width}").astype(U)
        out[at] = _mixed(codes, np.arange(len(at)) * size, size)
    return out


def _run_lengths(least: int, width: int):
    """Totals of the keys of a partition sorted by h, at least `least`, with their mixed values as h. Keys that share an h are
    told apart."""

    def totals(table: pa.Table) -> pa.RecordBatch:
        h, key, a = (table.column(x).combine_chunks() for x in ("h", "key", "a"))
        values = h.to_numpy()
        change = np.zeros(len(values), bool)
        change[:1] = True
        change[1:] = (values[1:] != values[:-1]) | pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(change)
        out = pa.table({"h": h.take(pa.array(at)), "key": key.take(pa.array(at)), "a": np.add.reduceat(a.to_numpy().astype(np.int64), at)})
        starts = values[at]
        if (starts[1:] == starts[:-1]).any():  # two keys of one h may alternate
            out = out.group_by(["h", "key"]).aggregate([("a", "sum")]).rename_columns(["h", "key", "a"])
        out = out.filter(pc.greater_equal(out["a"], least)).combine_chunks()
        return out.set_column(0, "h", pa.array(_mixed_keys(out["key"], width).view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            h = batch.column("h").to_numpy()
            start = int(np.searchsorted(h, h[-1], side="left"))  # the last value may go on in the next batch
            if start or (held and held[-1].column("h")[-1].as_py() != h[-1]):
                yield from totals(pa.concat_tables([*held, table.slice(0, start)])).to_batches()
                held = []
            held.append(table.slice(start))
        if held:
            yield from totals(pa.concat_tables(held)).to_batches()

    return run


def _counted(scratch: Scratch, docs: DataFrame, sizes: list[int], ids: Ids, part: int, part_shared, least: int, seed: int) -> DataFrame:
    """The phrases of some sizes that occur at least `least` times: h, key, a."""
    rows = docs.mapInArrow(tidy(_gram_counts(sizes, ids, part, part_shared, seed)), PARTIAL_ROWS)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal ranges of a hash hold about equal numbers of keys, whatever the words; the sort by one long is a radix sort
    share = F.shiftrightunsigned(F.xxhash64("key"), 40) * parts
    ranged = rows.repartitionById(parts, F.shiftrightunsigned(share, 24).cast("int"))
    ordered = ranged.select(F.xxhash64("key").alias("h"), "key", "a").sortWithinPartitions("h")
    return scratch.cut(ordered.mapInArrow(tidy(_run_lengths(least, ids.bytes)), GRAM_ROWS))


def dictionary(scratch: Scratch, docs: DataFrame) -> tuple[DataFrame, int]:
    """All words of (text, lang): code, lang, word, a; and the seed of their codes, under which no two share one."""
    for seed in range(8):
        rows = docs.mapInArrow(tidy(_word_counts(seed)), WORD_ROWS)
        counts = scratch.cut(rows.groupBy("code", "lang", "word").agg(F.sum("a").alias("a")))
        if not counts.groupBy("code").count().where("count > 1").limit(1).count():
            return counts, seed
        scratch.drop(counts)
    raise RuntimeError("no seed gives all words codes of their own")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the table's columns of their key (each is there), whatever share of the rows one key has."""
    uses = rows.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    return join_by_key(rows, table.join(uses, key), [key], "uses", total).drop("uses")


def _part(width: int, first: Column | int, words: Column | int | None = None) -> Column:
    """Words of the column key from the first (0 on), with ids of a width."""
    at = F.lit(first) if isinstance(first, int) else first
    many = F.lit(1 << 20) if words is None else (F.lit(words) if isinstance(words, int) else words)
    return F.substring(F.col("key"), at * width + 1, many * width)


def mine_phrases(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, inside: int = 100) -> DataFrame:
    """The collocations of each language of docs (text, lang), best first.

    Texts are lower-cased (A-Z) and split into pieces at sentence signs and line ends, pieces into words at spaces and tabs.
    Candidates have 2 to `longest` words and occur `least` times at least (a) in a language that has n words. A cut after k
    words gives the parts' counts l and r and the score floor(1000 * a * n / (l * r)); the lowest-scoring cut counts, of equal
    ones the first. A candidate inside a longer one that has `inside` percent of its occurrences at least is dropped.
    Returns lang, rank (1 to `top`), phrase, a, l, r, n, score; equal scores by a falling, then by the phrase's bytes.

    A null text is empty, a null language is `und`; an empty table and one without candidates give no rows. Texts are read
    whole, whatever their length; a text that is one word is one word. Repeated rows count each time. Other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words, seed = dictionary(scratch, docs)
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    # an id's bytes are a phrase of one word
    known, ids = numbered(scratch.cut(words.where(F.col("a") >= least).join(totals, "lang")))
    known, size = scratch.cut(known), (F.length("key") / ids.bytes).cast("int")
    counted, part, part_filter = [], 1, None
    for sizes in [s for s in ([2], [3], [*range(4, longest + 1)]) if s and s[-1] <= longest]:
        found = _counted(scratch, docs, sizes, ids, part, part_filter, least, seed)
        counted.append(found)
        if sizes[-1] < longest:
            part, part_filter = sizes[-1], id_filter(found, "h").shared
    candidates = counted[0]
    for found in counted[1:]:
        candidates = candidates.unionByName(found)
    candidates = candidates.select("key", "a", size.alias("size"))

    # the most frequent longer phrase around each candidate has one word more
    around = candidates.where("size > 2").select(F.explode(F.array(_part(ids.bytes, 0, F.col("size") - 1), _part(ids.bytes, 1))).alias("key"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
    kept = candidates.select("key", "a", F.lit(None).cast("long").alias("longer")).unionByName(around).groupBy("key").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    kept = scratch.cut(kept.where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True))).select("key", "a", size.alias("size")))

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select("key", "a", "k", _part(ids.bytes, 0, F.col("k")).alias("left"), _part(ids.bytes, F.col("k")).alias("right"))
    total = kept.agg(F.sum(F.col("size") - 1)).first()[0] or 0
    none = lambda kind: F.lit(None).cast(kind)
    table = known.select("key", "a", "lang", "n").unionByName(candidates.select("key", "a", none("string").alias("lang"), none("long").alias("n")))
    cuts = _looked_up(cuts, table.select(F.col("key").alias("left"), F.col("a").alias("l"), "lang", "n"), "left", total)
    cuts = _looked_up(cuts, table.select(F.col("key").alias("right"), F.col("a").alias("r")), "right", total)
    # the cut after the first word brings the language and its n
    best = cuts.groupBy("key").agg(F.max("lang").alias("lang"), F.max("n").alias("n"), F.max("a").alias("a"), F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    wide = lambda c: c.cast("decimal(18,0)")
    scored = F.transform("cuts", lambda c: F.struct(F.call_function("div", wide(F.col("a")) * wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"), wide(c["l"]) * wide(c["r"])).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    best = best.select("key", "lang", "n", "a", F.array_min(scored).alias("cut")).select("key", "lang", "n", "a", "cut.l", "cut.r", "cut.score")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = scratch.cut(best.withColumn("place", F.rank().over(order)).where(F.col("place") <= top))  # ties stay until they are spelled

    letters = best.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: _part(ids.bytes, i, 1))).alias("i", "letter"))
    spelled = letters.join(known.select(F.col("key").alias("letter"), "word"), "letter").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    phrases = best.join(spelled.select("key", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase")), "key")
    ranked = phrases.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL over `documents`, with the defaults above.
ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
spans AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + s - 1] AS g FROM spans, range(1, 6) AS sizes(s) WHERE i + s - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM spans GROUP BY lang),
candidates AS (SELECT * FROM f WHERE len(g) > 1),
inner_ones AS (SELECT DISTINCT c.lang, c.g FROM candidates c JOIN
  (SELECT lang, a, g[i:i + s - 1] AS sub FROM candidates, range(2, 5) AS sizes(s), range(1, 5) AS starts(i)
   WHERE s < len(g) AND i + s - 1 <= len(g)) x ON x.lang = c.lang AND x.sub = c.g AND 100 * x.a >= 100 * c.a),
kept AS (SELECT * FROM candidates ANTI JOIN inner_ones USING (lang, g)),
cuts AS (SELECT k.lang, k.g, k.a, c AS cut, x.a AS l, y.a AS r, n, (1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM kept k JOIN range(1, 5) AS c_(c) ON c < len(g) JOIN f x ON x.lang = k.lang AND x.g = k.g[1:c]
  JOIN f y ON y.lang = k.lang AND y.g = k.g[c + 1:] JOIN totals t ON t.lang = k.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase,
  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
