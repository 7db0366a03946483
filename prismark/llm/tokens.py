"""Token counts at every prefix of a text, for byte-pair vocabularies whose tokens never cross white space.

The recurrence runs over the pieces of a text: count(prefix up to piece j) = count(prefix up to piece j - 1) + tokens of
piece j. Pieces are runs of non-white bytes, cut further where an ASCII letter meets a full stop, comma or the like, where
the vocabulary's own pattern always cuts. The public library encodes each distinct piece once per worker; a whole buffer is
then priced by array look-ups.

Inside a piece the recurrence runs over the merges (`Merges`): the encoding of a word's prefix is that of a shorter prefix and
one token more, the only token that stays whole beside the token before it. So count(prefix) = count(shorter prefix) + 1, and a row
of counts for all prefixes of a piece comes out of one pass. Any prefix of a text so costs one look-up in its table and one in a
row: truncation and budget questions need no second encoding.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash

#: Distinct pieces that a Python worker remembers; then it starts afresh. Bounds memory, never results.
REMEMBERED = 500_000
CHUNK_BYTES = 1 << 20
#: Words that the library encodes at a time.
LINE = 64

# Signs at which a piece is cut next to an ASCII letter; not those of contractions and special strings.
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "!\"#$%&()*+,-./:;=?@[]^_`{}~"]] = True

_encoders: dict[str, Encoder] = {}
#: Pieces whose bytes stand for themselves in the vocabulary, and how its pattern cuts them; contractions and special strings aside.
_PLAIN = re.compile(r"[!-&(-;=-~]+")
_WORD = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
_END = "</w>"
#: How the pattern cuts other pieces, contractions aside.
_CUT = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: What makes the encoding of a prefix more than its words': contractions, special strings, a letter whose small form hangs on what follows, rare white space.
_BOUND = re.compile(r"'(?:[stmd]|re|ve|ll)|<\|(?:start|end)oftext\|>|\u03a3|[\x1c-\x1f\x85\u1680\u180e\u2028\u2029\u200b\ufeff]", re.IGNORECASE)


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


_SYMBOLS = _byte_symbols()


class Merges:
    """The merges of a byte-pair vocabulary with word ends, for counts at every prefix of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.vocabulary = model["vocab"]
        self.longest = max(map(len, self.vocabulary))
        self.beside: dict[tuple[str, str], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        return [*token[: -len(_END) - 1], token[-len(_END) - 1 :]] if token.endswith(_END) else list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        """The merges in their order, the leftmost first among equals."""
        while len(symbols) > 1:
            rank, k = min((self.rank.get(p, len(self.rank)), k) for k, p in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.rank):
                break
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols

    def stays(self, before: str, token: str) -> bool:
        """Whether two tokens next to each other are left as they are; an empty one before stands for a word's beginning."""
        key = before, token
        if key not in self.beside:
            if len(self.beside) > REMEMBERED:
                self.beside.clear()
            self.beside[key] = self._merged((self._symbols(before) if before else []) + self._symbols(token)) == ([before, token] if before else [token])
        return self.beside[key]

    def row(self, word: str) -> list[int]:
        """Tokens of each prefix of a word of the pattern, each with its own word end."""
        count, last, out = [0] + [-1] * len(word), [""] * (len(word) + 1), [0]
        for k in range(1, len(word) + 1):
            whole = None
            for j in range(max(0, k - self.longest), k):
                token = word[j:k]
                if count[j] < 0:
                    continue
                if count[k] < 0 and token in self.vocabulary and self.stays(last[j], token):
                    count[k], last[k] = count[j] + 1, token
                if whole is None and token + _END in self.vocabulary and self.stays(last[j], token + _END):
                    whole = count[j] + 1
            out.append(whole)
        return out


class Encoder:
    """A vocabulary file with what it has encoded so far in this process."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.path, self.merges = path, None
        vocabulary = self.library.get_vocab()
        self.ending = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ending[[k for token, k in vocabulary.items() if token.endswith(_END)]] = True
        self.forget()

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def forget(self) -> None:
        """Rows of the pieces by hash, and where the ids of each lie in the pool."""
        self.rows = wordhash.Table(16)
        self.first, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each). Words of letters alone are encoded many at a time, with spaces between them.

        The ids of each end with its only token with a word end; where a line has more of these than words, its words are encoded one by one.
        """
        alone = [k for k, t in enumerate(texts) if not t.isalpha()]
        words = [k for k, t in enumerate(texts) if t.isalpha()]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        for places, ids in zip(lines, self.encode([" ".join([texts[k] for k in x]) for x in lines])):
            ids = np.array(ids, np.uint32)
            ends = np.flatnonzero(self.ending[ids]) + 1
            if len(ends) == len(places) and ends[-1] == len(ids):
                found.append((np.array(places), np.diff(ends, prepend=0), ids))
            else:
                alone += places
        if alone:
            ids = self.encode([texts[k] for k in alone])
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            found.append((np.array(alone), size, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum()))))
        places, size, ids = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))
        first, order = np.cumsum(size) - size, np.argsort(places)
        size = size[order]
        return ids[np.repeat(first[order] - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        for k in range(0, len(texts), 20_000):
            ids, size = self.flat(texts[k : k + 20_000])
            total, at = len(ids), self.rows.n
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while at + len(size) > len(self.size):
                self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
            self.pool[self.used : self.used + total] = ids
            self.first[at : at + len(size)] = self.used + np.cumsum(size) - size
            self.size[at : at + len(size)] = size
            self.rows.add(hashes[k : k + 20_000])
            self.used += total

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the tables of each piece, end of each piece, pieces before each document)."""
        # Letters of ASCII by arithmetic; bytes from 128 on are none.
        letter, sign = ((buf | np.uint8(32)) - np.uint8(97)) < 26, _SIGN.take(buf)
        edge = np.zeros(len(buf), bool)
        edge[1:] = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        starts, ends, firsts = wordhash.word_spans(buf, offsets, edge)
        hashes = wordhash.substring_hashes(wordhash.prefix_sums(wordhash.lower(buf)), starts, ends)
        special = np.append(0, np.cumsum(buf == ord("<")))
        special = np.flatnonzero(special[ends] > special[starts])
        if len(special):  # special strings are told by case
            hashes[special] = wordhash.mix(wordhash.substring_hashes(wordhash.prefix_sums(buf), starts[special], ends[special]) + np.uint64(1))
        if self.rows.n > REMEMBERED:
            self.forget()
        place = self.rows.find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            kinds, one = np.unique(hashes[new], return_index=True)
            raw, one = buf.tobytes(), new[one]
            self._learn(kinds, [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())])
            place[new] = self.rows.find(hashes[new])
        self.starts = starts
        return place, ends, firsts

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        place, _, firsts = self.pieces(buf, offsets)
        return np.diff(np.append(0, np.cumsum(self.size[place]))[firsts])

    def tables(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end of each piece in its document's bytes, tokens of its document up to there, pieces before each document)."""
        place, ends, firsts = self.pieces(buf, offsets)
        upto = np.cumsum(self.size[place])
        before = np.append(0, upto)[firsts[:-1]]
        many = np.diff(firsts)
        return ends - np.repeat(offsets[:-1], many), upto - np.repeat(before, many), firsts

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, one after another, and where each begins."""
        place, _, firsts = self.pieces(buf, offsets)
        size = self.size[place]
        upto = np.append(0, np.cumsum(size))
        return self.pool[np.repeat(self.first[place] - upto[:-1], size) + np.arange(upto[-1])], upto[firsts]

    def at(self, text: str, chars: int) -> int:
        """Tokens of text[:chars], from the text's table and the row of one piece."""
        raw = np.frombuffer(text.encode(), np.uint8)
        place, ends, _ = self.pieces(raw, np.array([0, len(raw)]))
        starts, upto = self.starts, np.append(0, np.cumsum(self.size[place]))
        stop = len(text[:chars].encode())
        k = int(np.searchsorted(ends, stop, "right"))
        if k == len(ends) or starts[k] >= stop:
            return int(upto[k])
        return int(upto[k]) + self.row(raw[starts[k] : ends[k]].tobytes().decode())[len(raw[starts[k] : stop].tobytes().decode())]

    def _row_by_bytes(self, piece: str) -> list[int] | None:
        """The same for a piece of any characters, by the merges over its bytes; None for what `_BOUND` names and where the whole's count is not the library's."""
        if _BOUND.search(piece) or not unicodedata.is_normalized("NFC", piece):
            return None  # a part of a normalised piece is normalised
        small = [c.lower() for c in piece]
        text = "".join(small)
        at = np.cumsum([0, *(len(c.encode()) for c in small)])  # bytes before each code point
        counts, total, done, byte = np.zeros(int(at[-1]) + 1, np.int64), 0, 0, 0
        for word in _CUT.finditer(text):
            skipped = len(text[done : word.start()].encode())
            counts[byte : byte + skipped + 1] = total
            byte += skipped
            inside = self.merges.row("".join(_SYMBOLS[b] for b in word.group().encode()))
            counts[byte + 1 : byte + len(inside)] = [total + (n or 0) for n in inside[1:]]
            byte, total, done = byte + len(inside) - 1, total + inside[-1], word.end()
        counts[byte + 1 :] = total
        out = counts[at].tolist()
        return out if out[-1] == len(self.encode([piece])[0]) else None

    def row(self, piece: str) -> list[int]:
        """Tokens of each prefix of a piece, from the empty one to the whole, by the merges; pieces that `_BOUND` names, or not normalised ones, by the library."""
        if self.merges is None:
            self.merges = Merges(self.path)
        if not _PLAIN.fullmatch(piece):
            return self._row_by_bytes(piece) or [0, *map(len, self.encode([piece[:k] for k in range(1, len(piece) + 1)]))]
        out = [0]
        for word in _WORD.findall(piece.lower()):
            out += [out[-1] + n for n in self.merges.row(word)[1:]]
        return out

    def longest(self, raw: bytes, budget: int) -> int:
        """Code points of the longest prefix of a piece with at most `budget` tokens."""
        return max(k for k, n in enumerate(self.row(raw.decode())) if n <= budget)


def _count(path: str, limit: int):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
                own, at = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                ends, upto, firsts = encoder.tables(own, at)
                counts = np.append(0, upto)[firsts[1:]] * (np.diff(firsts) > 0)
                lead = np.append(0, np.cumsum((own & 0xC0) != 0x80))  # code points before each byte
                within = np.diff(lead[at])
                for d in np.flatnonzero(counts > limit):
                    k = int(firsts[d] + np.searchsorted(upto[firsts[d] : firsts[d + 1]], limit, "right"))  # the piece that goes over it
                    start, stop = int(encoder.starts[k]), int(at[d] + ends[k])
                    within[d] = lead[start] - lead[at[d]] + encoder.longest(own[start:stop].tobytes(), limit - (int(upto[k - 1]) if k > firsts[d] else 0))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *(pa.array(x.astype(np.int64)) for x in (np.diff(at), counts)), pa.array(counts > limit), pa.array(within.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, chars_within) for every row.

    n_tokens counts the whole text without begin, end or added special tokens; chars_within is the longest prefix, in code
    points, that has at most `limit` tokens (the whole text, if it has). Null counts as empty: 0 bytes, 0 tokens. Rows
    without an id and repeated rows give rows of their own; other columns are not read. `vocabulary` is the file's path
    on every executor.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_count(vocabulary, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, chars_within long")


def _tables(path: str):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            buf, offsets = wordhash.buffers(batch.column(1))
            for a, b in wordhash.chunks(offsets, CHUNK_BYTES):
                ends, upto, firsts = encoder.tables(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = [pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (ends, upto)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *lists], names=["doc_id", "ends", "counts"])

    return run


def prefix_tables(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ends, counts): for each piece of a text, the byte where it ends and the tokens up to there."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_tables(vocabulary), f"doc_id {kind}, ends array<int>, counts array<int>")


def _prefixes(path: str):
    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                ends, upto, _ = encoder.tables(raw, np.array([0, len(raw)]))
                lead = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                first, last = lead[encoder.starts], lead[ends]
                out = np.zeros(int(lead[-1]) + 1, np.int32)
                np.add.at(out, last, np.diff(np.append(0, upto)))
                out = np.cumsum(out).astype(np.int32)  # white space and piece ends; inside pieces the row is added
                for a, b, s, e in zip(first.tolist(), last.tolist(), encoder.starts.tolist(), ends.tolist()):
                    if b - a > 1:
                        out[a + 1 : b] += np.array(encoder.row(raw[s:e].tobytes().decode())[1:-1], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], pa.array([out], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return run


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): the tokens of every prefix of a text, counts[k] those of its first k code points. Null counts as empty."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_prefixes(vocabulary), f"doc_id {kind}, counts array<int>")
