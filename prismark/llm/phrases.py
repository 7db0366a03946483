"""Phrases that stand together more often than their parts would by chance, found level by level.

A phrase can be frequent only if both phrases that it has less one word at either end are. So level k counts just those runs of k words
whose two overlapping runs of k-1 words were frequent. What is broadcast for that is a Bloom filter of the level below, of bounded size
(`FILTER_WORDS`): what it lets through by mistake is counted as well and then found to be rare, so results are exact at every size.

Each task cuts its texts into words with numpy and counts by dictionary codes, which are exact, before anything is shuffled. The level
tables hold every frequent phrase with its count; cuts are scored by looking both parts up in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import membership, wordhash
from .store import batches_of, durable, looked_up

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)

#: Bytes at which words end (space, tab and what ends a piece), and those that end a piece.
ENDS, BREAKS = np.zeros(256, bool), np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
ENDS[list(b" \t")] = True
ENDS |= BREAKS

CHUNK_BYTES = 1 << 19
#: Texts that a worker holds at a time.
BATCH_ROWS = 1_000
#: The most 64-bit words of a level's filter: 16 MB. It has 16 bits for each phrase as long as that is enough.
FILTER_WORDS = 1 << 21
COUNTS = "lang string, phrase string, n long"


class Words:
    """The words of some texts: their codes, hashes, text and piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        """`langs` has a number for each text."""
        buf = wordhash.LOWER[buf]
        dark = ~ENDS[buf]
        opens, closes = dark.copy(), dark.copy()
        opens[1:] &= ~dark[:-1]
        closes[:-1] &= ~dark[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(buf))]
        opens[cut] |= dark[cut]
        closes[cut - 1] |= dark[cut - 1]
        self.starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        text = np.searchsorted(offsets, self.starts, "right") - 1
        self.piece = np.cumsum(BREAKS[buf])[self.starts] + text  # both only grow, so equal sums mean the same text and piece
        self.lang = langs[text]
        bounds = np.concatenate([[0], np.cumsum(ends - self.starts)]).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[dark]))]).dictionary_encode()
        self.code, self.known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        own, at = wordhash.buffers(self.known)
        self.hashes = wordhash.substring_hashes(wordhash.prefix_sums(own), at[:-1], at[1:])[self.code]

    def runs(self, k: int) -> np.ndarray:
        """First words of all runs of k words of one piece."""
        n = max(0, len(self.code) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 : k - 1 + n])

    def names(self, first: np.ndarray, k: int, salts: np.ndarray) -> np.ndarray:
        """A hash of the language and words of each run."""
        out = salts[self.lang[first]]
        for j in range(k):
            out = wordhash.mix(out * _STEP + self.hashes[first + j])
        return out

    def counted(self, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(a first word, count) of each distinct run of one language."""
        code, wide = self.lang[first].astype(np.int64), len(self.known)
        for j in range(k):
            if len(code) and (int(code.max()) + 1) * wide >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
            code = code * wide + self.code[first + j]
        _, at, n = np.unique(code, return_index=True, return_counts=True)
        return first[at], n

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        parts = [self.known.take(pa.array(self.code[first + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]).cast(pa.binary()).cast(pa.string())


def _salts(names: pa.Array) -> np.ndarray:
    buf, at = wordhash.buffers(names)
    return wordhash.substring_hashes(wordhash.prefix_sums(buf), at[:-1], at[1:])


def _languages(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.fill_null("und").dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _sections(buf: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(start, own, end) of the sections of a long text: what begins before `own` are the k-1 words before it."""
    own = 0
    while own < len(buf):
        end, wide = min(own + CHUNK_BYTES, len(buf)), 1 << 12
        while end < len(buf):  # on to the end of the word
            stop = np.flatnonzero(ENDS[buf[end - 1 : end - 1 + wide]])
            if len(stop):
                end += int(stop[0])
                break
            end, wide = min(end + wide, len(buf)), wide * 4
        start, wide = own, 1 << 8
        while k > 1 and start > 0:
            start = max(0, own - wide)
            dark = ~ENDS[buf[start:own]]
            words = start + np.flatnonzero(dark[1:] & ~dark[:-1]) + 1
            if len(words) >= k - 1:
                start = int(words[-(k - 1)])
                break
            wide *= 4
        yield start, own, end
        own = end


def _chunks(batch: pa.RecordBatch, k: int) -> Iterator[tuple[Words, int, pa.Array]]:
    """(words, how many of them are only there to begin runs, languages) of all texts of a batch (lang, text)."""
    lang, names = _languages(batch.column(0))
    buf, offsets = wordhash.buffers(batch.column(1))
    for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
        if offsets[b] - offsets[a] <= CHUNK_BYTES:
            yield Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lang[a:b]), 0, names
            continue
        text = buf[offsets[a] : offsets[b]]
        for start, own, end in _sections(text, k):
            words = Words(text[start:end], np.array([0, end - start]), lang[a:b])
            yield words, int(np.searchsorted(words.starts, own - start)), names


def _level(k: int, shared):
    """Counts of runs of k words whose overlapping runs of k-1 the filter knows; at level 1 of all words, and under the empty phrase their total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared is not None else None
        for batch in batches:
            for words, lead, names in _chunks(batch, k):
                if not len(words.code):
                    continue
                first = words.runs(k)
                first = first[first + k - 1 >= lead]
                if known is not None:
                    salts = _salts(names)
                    shorter = words.runs(k - 1)
                    frequent = np.zeros(len(words.code) + 1, bool)
                    frequent[shorter] = known.maybe(words.names(shorter, k - 1, salts).view(np.int64))
                    first = first[frequent[first] & frequent[first + 1]]
                at, n = words.counted(first, k)
                lang, phrase = words.lang[at], words.phrases(at, k)
                if k == 1:
                    total = np.bincount(words.lang[lead:], minlength=len(names))
                    there = np.flatnonzero(total)
                    lang, n = np.concatenate([lang, there]), np.concatenate([n, total[there]])
                    phrase = pa.concat_arrays([phrase, pa.array([""] * len(there), pa.string())])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)).cast(pa.string()), phrase, pa.array(n.astype(np.int64))], names=["lang", "phrase", "n"])

    return run


def _named(k: int):
    """Hashes of stored phrases (lang, phrase) of k words, as `Words.names` has them for runs in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, lead, names in _chunks(batch, k):
                first = words.runs(k)
                yield pa.RecordBatch.from_arrays([pa.array(words.names(first[first + k - 1 >= lead], k, _salts(names)).view(np.int64))], names=["id"])

    return run


def levels(docs: DataFrame, longest: int, least: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1 to `longest` words with n >= least, and (lang, n) of all words, from (lang, text)."""
    spark, out, totals = docs.sparkSession, [], None
    for k in range(1, longest + 1):
        shared = None
        if k > 1:
            bits = 16 * out[-1].count()
            shared = spark.sparkContext.broadcast(membership.filter_of(out[-1].mapInArrow(_named(k - 1), "id long"), min(FILTER_WORDS, max(64, bits // 64))))
        counts = docs.mapInArrow(_level(k, shared), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        with batches_of(spark, BATCH_ROWS):
            stored = durable(counts.where(f"n >= {least} or phrase = ''"), f"level{k}")
        if k == 1:
            totals = stored.where("phrase = ''").select("lang", "n")
        out.append(stored.where("phrase != ''"))
    return out, totals


def _part(words, a, n):
    return F.array_join(F.slice(words, a, n), " ")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z) and end pieces at `.,;:!?` and line ends; words lie between spaces and tabs. n counts a language's
    words, a a phrase's occurrences within pieces, overlaps included. Of all cuts of a phrase in two, with l and r occurrences, the one with the
    least floor(1000000 a a / (l r)) counts, of equal ones the first. A phrase inside a longer one that has at least
    `inside_percent` of its occurrences is dropped, whether the longer one is dropped or not. Ranked by score and a, falling, then phrase.

    A null text counts as empty, a null language as `und`; ids and other columns are not read, and repeated rows count each. Texts of any length are
    read in sections. An empty table, or one without frequent phrases, gives an empty result.
    """
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    tables, totals = levels(docs, longest, least)
    candidates = None
    for k, t in enumerate(tables[1:], 2):
        row = t.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), F.split("phrase", " ").alias("words"))
        candidates = row if candidates is None else candidates.unionByName(row)
    inner = None
    for k, t in enumerate(tables[2:], 3):
        words = F.split("phrase", " ")
        subs = [_part(words, a, m) for m in range(2, k) for a in range(1, k - m + 2)]
        row = t.select("lang", F.col("n"), F.explode(F.array(*subs)).alias("phrase"))
        inner = row if inner is None else inner.unionByName(row)
    if inner is not None:
        most = inner.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        candidates = candidates.join(most, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {inside_percent} * a")
    cut = candidates.select("lang", "phrase", "a", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = durable(cut.select("lang", "phrase", "a", "cut", _part(F.col("words"), F.lit(1), F.col("cut")).alias("left"), _part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right")), "cuts")
    known = tables[0]
    for t in tables[1:-1]:
        known = known.unionByName(t)
    one = looked_up(cuts, known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"], ["phrase", "cut"])
    both = looked_up(durable(one, "lefts"), known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"], ["phrase", "cut"])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = both.select("lang", "phrase", F.struct(score.alias("score"), "cut", "a", "l", "r").alias("x")).groupBy("lang", "phrase").agg(F.min("x").alias("x")).select("lang", "phrase", "x.*")
    scored = durable(scored.withColumn("bin", F.floor(16 * F.log2(F.col("score") + 1))), "scored")
    higher = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)  # over some 300 bins a language
    bins = scored.groupBy("lang", "bin").agg(F.count("*").alias("rows")).withColumn("above", F.coalesce(F.sum("rows").over(higher), F.lit(0)))
    floors = bins.where(f"above < {top}").groupBy("lang").agg(F.min("bin").alias("floor"))
    near = looked_up(scored, floors, ["lang"], ["phrase"]).where("bin >= floor")  # the first rows of each language and the rest of their last bin
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))).where(f"rank <= {top}")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
runs AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM runs GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
left_ AS (SELECT c.* FROM cand c LEFT JOIN most m USING (lang, phrase) WHERE m.longer IS NULL OR 100 * m.longer < 50 * c.a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM left_),
scored AS (
  SELECT c.lang, c.phrase, c.a, p.n AS l, q.n AS r, c.cut, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(p.n AS HUGEINT) * q.n) AS BIGINT) AS score
  FROM cuts c JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
