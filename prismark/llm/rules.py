"""Quality rules as a short-circuit cascade.

A rule rejects a text by integer comparisons of features. On a sample the cost of each feature (seconds of work a byte) and the texts that each rule
rejects are measured; then rules are ordered by rejections per cost, one after another: the next rule is the one that rejects most of the sample's
texts that all rules before it let through, for the time that its features, as far as they are not there yet, take. Texts
that a rule rejects are not looked at by later ones, and features are computed for those texts only that a rule asks them for.

The order changes the time, never a verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .lexical import sample_by_hash

#: About so many rows are measured.
SAMPLE_ROWS = 4_000
CHUNK_BYTES = 1 << 20
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_ASCII = np.arange(256)
_SYMBOL, _UPPER, _SMALL, _LETTER = np.isin(_ASCII, list(SYMBOLS.encode())), (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122), None
_LETTER = _UPPER | _SMALL | (_ASCII >= 128)
_NEXT = (_ASCII & 0xC0) == 0x80  # a code point's later bytes


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


class Texts:
    """Some texts as bytes, with what their features share; each part is computed when first asked for."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets, self._have = buf, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def part(self, name: str):
        if name not in self._have:
            self._have[name] = FEATURES[name][0](self) if name in FEATURES else getattr(self, f"_{name}")()
        return self._have[name]

    def only(self, keep: np.ndarray) -> Texts:
        """Those texts alone; features that are there go along."""
        if keep.all():
            return self
        at = np.flatnonzero(keep)
        spans = [self.buf[self.offsets[i] : self.offsets[i + 1]] for i in at]
        out = Texts(np.concatenate(spans) if spans else self.buf[:0], np.concatenate([[0], np.cumsum(np.diff(self.offsets)[at])]).astype(np.int64))
        out._have = {k: v[at] for k, v in self._have.items() if k in FEATURES}
        return out

    def _spans(self):
        """(starts, ends, words before each text)"""
        return wordhash.word_spans(self.buf, self.offsets)

    def by_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a flag of each byte over the texts."""
        return np.diff(_before(flags)[self.offsets])

    def by_word(self, table: np.ndarray) -> np.ndarray:
        starts, ends, _ = self.part("spans")
        sums = _before(table[self.buf])
        return sums[ends] - sums[starts]

    def words_with(self, flags: np.ndarray) -> np.ndarray:
        return np.diff(_before(flags)[self.part("spans")[2]])

    def _lines(self):
        """(starts, ends, text of each, whether it has a word) of the \\n-split lines."""
        ends = np.union1d(np.flatnonzero(self.buf == 10), self.offsets[1:][np.diff(self.offsets) > 0])
        cut = np.isin(ends, self.offsets[1:])  # a text may end with \n: then an empty line follows, which has no word and is left out
        starts = np.concatenate([[0], np.where(cut, ends, ends + 1)[:-1]]) if len(ends) else ends
        fine = starts < ends
        starts, ends = starts[fine], ends[fine]
        dark = _before(~wordhash.WHITE[self.buf])
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1, dark[ends] > dark[starts]


def _strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans, which do not overlap and rise, as an Arrow array."""
    inside = np.zeros(len(buf) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    body = np.ascontiguousarray(buf[np.cumsum(inside)[:-1] > 0])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(body)])


def _codes(strings: pa.Array) -> np.ndarray:
    return strings.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _duplicate_lines(t: Texts) -> np.ndarray:
    """Lines with a word that are equal to an earlier line of the text."""
    starts, ends, text, wordy = t.part("lines")
    starts, ends, text = starts[wordy], ends[wordy], text[wordy]
    code = _codes(_strings(t.buf, starts, ends))
    distinct = np.unique(text * (int(code.max(initial=0)) + 1) + code) // (int(code.max(initial=0)) + 1)
    return np.bincount(text, minlength=len(t)) - np.bincount(distinct, minlength=len(t))


def _repeated_words(t: Texts, window: int = 3) -> np.ndarray:
    """Words inside runs of `window` words that the text has at least twice, the first time too."""
    starts, ends, firsts = t.part("spans")
    text = np.repeat(np.arange(len(t)), np.diff(firsts))
    n = max(0, len(starts) - window + 1)
    at = np.flatnonzero(text[:n] == text[window - 1 : window - 1 + n])
    words = _codes(_strings(t.buf, starts, ends))
    wide = int(words.max(initial=0)) + 1
    key = text[at]
    for j in range(window):
        if len(key) and (int(key.max()) + 1) * wide >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + words[at + j]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = at[count[inverse] > 1]
    covered = np.zeros(len(starts), bool)
    for j in range(window):
        covered[again + j] = True
    return t.words_with(covered)


def _starting(t: Texts, marks: Sequence[bytes]) -> np.ndarray:
    """Lines with a word whose first word begins with one of the marks, which have up to 3 bytes."""
    starts, ends, text, wordy = t.part("lines")
    dark = np.flatnonzero(~wordhash.WHITE[t.buf])
    first = dark[np.minimum(np.searchsorted(dark, starts[wordy]), max(0, len(dark) - 1))] if wordy.any() else starts[:0]
    wide = np.concatenate([t.buf, np.zeros(3, np.uint8)])
    hit = np.zeros(len(first), bool)
    for mark in marks:
        hit |= np.all([wide[first + j] == b for j, b in enumerate(mark)], axis=0) if len(first) else hit
    return np.bincount(text[wordy][hit], minlength=len(t))


#: name -> (counts of it in each text, what it is computed from, the SQL of the same over lists w of words and lines of lines with a word)
FEATURES: dict[str, tuple[Callable[[Texts], np.ndarray], tuple[str, ...], str]] = {
    "n_words": (lambda t: np.diff(t.part("spans")[2]), ("spans",), "len(w)"),
    "word_chars": (lambda t: t.by_text(~wordhash.WHITE[t.buf] & ~_NEXT[t.buf]), (), "length(array_to_string(w, ''))"),
    "n_symbols": (lambda t: t.by_text(_SYMBOL[t.buf]), (), f"len(regexp_extract_all(t, '[{SYMBOLS}]'))"),
    "n_dup_lines": (_duplicate_lines, ("lines",), "len(lines) - len(list_distinct(lines))"),
    "n_repeat_words": (_repeated_words, ("spans",), ""),
    "n_lines": (lambda t: np.bincount(t.part("lines")[2][t.part("lines")[3]], minlength=len(t)), ("lines",), "len(lines)"),
    "n_lettered": (lambda t: t.words_with(t.by_word(_LETTER) > 0), ("spans",), "len([x for x in w if regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]')])"),
    "n_capital": (lambda t: t.words_with((t.by_word(_UPPER) > 1) & (t.by_word(_SMALL) == 0)), ("spans",), "len([x for x in w if regexp_matches(x, '[A-Z](?s:.)*[A-Z]') AND NOT regexp_matches(x, '[a-z]')])"),
    "n_shouts": (lambda t: t.by_text(t.buf == ord("!")), (), "len(regexp_extract_all(t, '!'))"),
    "n_bullets": (lambda t: _starting(t, (b"-", b"*", "•".encode())), ("lines",), "len([x for x in lines if regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]')])"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where `left` > `right` + `spare`, two sums of features with whole factors."""

    name: str
    left: dict[str, int]
    right: dict[str, int]
    spare: int = 0

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys([*self.left, *self.right]))

    def rejects(self, t: Texts) -> np.ndarray:
        side = lambda x: sum((k * t.part(f).astype(np.int64) for f, k in x.items()), np.zeros(len(t), np.int64))
        return side(self.left) > side(self.right) + self.spare

    def sql(self) -> str:
        side = lambda x: " + ".join(f"{k} * {f}" for f, k in x.items())
        return f"{side(self.left)} > {side(self.right)} + {self.spare}"


#: Words of less than 2 or more than 12 characters on average; over 1 symbol or 1 exclamation mark to 5 words; over 3 in 10 lines said before, two
#: lines aside; less than 8 in 10 words with a letter; over 3 in 10 words in capitals; over 9 in 10 lines as bullets, two lines aside; over half of the
#: words in repeated runs.
RULES = (
    Rule("short_words", {"n_words": 2}, {"word_chars": 1}),
    Rule("long_words", {"word_chars": 1}, {"n_words": 12}),
    Rule("symbols", {"n_symbols": 5}, {"n_words": 1}),
    Rule("shouting", {"n_shouts": 5}, {"n_words": 1}),
    Rule("repeated_lines", {"n_dup_lines": 10}, {"n_lines": 3}, spare=20),
    Rule("unlettered", {"n_words": 8}, {"n_lettered": 10}),
    Rule("capitals", {"n_capital": 10}, {"n_words": 3}),
    Rule("bullets", {"n_bullets": 10}, {"n_lines": 9}, spare=18),
    Rule("repeated_words", {"n_repeat_words": 100}, {"n_words": 50}),
)
#: The rules of the base verdict: too few words, or too many repeated ones.
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Step:
    rule: Rule
    seconds_per_mb: float
    rejected: int
    seen: int


@dataclass(frozen=True)
class Cascade:
    """Rules in the order in which they are tried, with what the sample said of each."""

    steps: tuple[Step, ...]

    def kept(self, t: Texts, alive: np.ndarray) -> np.ndarray:
        """Which of the texts that are still `alive` no rule rejects."""
        alive, at = alive.copy(), np.flatnonzero(alive)
        t = t.only(alive)
        for step in self.steps:
            if not len(at):
                break
            bad = step.rule.rejects(t)
            alive[at[bad]] = False
            at, t = at[~bad], t.only(~bad)
        return alive


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Texts]]:
    buf, offsets = wordhash.buffers(column)
    for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
        yield a, b, Texts(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _measured(rules: Sequence[Rule]):
    """Seconds of each part and feature, and how many texts each set of rules rejects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took: dict[str, float] = {}
        found: dict[int, int] = {}
        size = 0
        for batch in batches:
            for _, _, t in _chunks(batch.column(0)):
                for name in dict.fromkeys(p for r in rules for f in r.features for p in (*FEATURES[f][1], f)):
                    began = time.thread_time()
                    t.part(name)
                    took[name] = took.get(name, 0.0) + time.thread_time() - began
                sets = sum((r.rejects(t).astype(np.int64) << k for k, r in enumerate(rules)), np.zeros(len(t), np.int64))
                for s, n in zip(*np.unique(sets, return_counts=True)):
                    found[int(s)] = found.get(int(s), 0) + int(n)
                size += len(t.buf)
        rows = [("size", 0, float(size)), *((k, 0, v) for k, v in took.items()), *(("set", s, float(n)) for s, n in found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["what", "which", "value"])

    return run


def ordered(rules: Sequence[Rule], seconds: dict[str, float], sets: dict[int, int], mb: float, given: Sequence[str] = ()) -> Cascade:
    """The rules by rejections per cost, each judged on what those before it let through and by the features still missing."""
    have, left, steps = {p for f in given for p in (f, *FEATURES[f][1])}, list(enumerate(rules)), []
    alive = dict(sets)
    while left:
        missing = lambda r: {p for f in r.features for p in (*FEATURES[f][1], f)} - have
        cost = lambda r: sum(seconds.get(p, 0.0) for p in missing(r)) + 1e-6 * mb
        hits = lambda k: sum(n for s, n in alive.items() if s >> k & 1)
        k, rule = max(left, key=lambda x: (hits(x[0]) / cost(x[1]) if mb else 0.0, -x[0]))
        steps.append(Step(rule, cost(rule) / mb if mb else 0.0, hits(k), sum(alive.values())))
        have |= missing(rule)
        alive = {s: n for s, n in alive.items() if not s >> k & 1}
        left.remove((k, rule))
    return Cascade(tuple(steps))


def fit(docs: DataFrame, rules: Sequence[Rule] = RULES, given: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Cascade:
    """The cascade for `docs`, from about `sample_rows` rows by a hash of their ids. The driver gets sums by part and by set of rules.

    Features in `given` cost nothing. Without rows the rules stay in their own order.
    """
    sample = sample_by_hash(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sample_rows, "doc_id", "rules")
    sums = sample.select("text").mapInArrow(_measured(rules), "what string, which long, value double").groupBy("what", "which").agg(F.sum("value").alias("value")).collect()
    sets = {r["which"]: int(r["value"]) for r in sums if r["what"] == "set"}
    mb = sum(r["value"] for r in sums if r["what"] == "size") / 1e6
    return ordered(rules, {r["what"]: r["value"] for r in sums if r["what"] not in ("set", "size")}, sets, mb, given)


def _judged(cascade: Cascade):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, t in _chunks(batch.column(1)):
                base = {name: t.part(name).astype(np.int64) for name in BASE}
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                columns = [batch.column(0).slice(a, b - a), *(pa.array(base[n]) for n in BASE), pa.array(failed), pa.array(cascade.kept(t, ~failed))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *BASE, "base_failed", "kept"])

    return run


def judged(docs: DataFrame, cascade: Cascade | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for every row.

    The base verdict fails texts of under 50 words, or of which over half lie in runs of three words said at least twice; what is left
    goes through the cascade, whose base features are there already. A null text has no words and fails, like an empty one; null and repeated ids
    are carried, and other columns are not read. An empty table gives an empty result. A text is measured whole, however long.
    """
    cascade = cascade or fit(docs, given=BASE, id_col=id_col, text_col=text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_judged(cascade), f"doc_id {kind}, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, kept boolean")


def _passing(cascade: Cascade, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b, t in _chunks(batch.column(text)):
                keep[a:b] = cascade.kept(t, np.ones(b - a, bool))
            yield batch.filter(pa.array(keep))

    return run


def without_poor(docs: DataFrame, cascade: Cascade | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with all their columns; each text is looked at by as few rules as its verdict needs.

    A null or empty text breaks no rule and stays: the base verdict is not asked here.
    """
    cascade = cascade or fit(docs, id_col=id_col, text_col=text_col)
    return docs.mapInArrow(_passing(cascade, docs.columns.index(text_col)), docs.schema)


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """The same over `documents`."""
    words = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    columns = ", ".join(f"{sql} AS {name}" for name, (_, _, sql) in FEATURES.items() if sql)
    bad = " OR ".join(f"({r.sql()})" for r in rules)
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents),
cut AS MATERIALIZED (SELECT *, {words} AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM texts),
windows AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, w FROM cut WHERE len(w) > 2),
again AS (SELECT row, unnest(list(i)) AS i FROM windows GROUP BY row, w[i:i + 2] HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i) AS n_repeat_words FROM (SELECT row, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY row),
counted AS (SELECT doc_id, {columns}, coalesce(n_repeat_words, 0) AS n_repeat_words FROM cut LEFT JOIN covered USING (row)),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counted)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR {bad}) AS kept FROM based"""
