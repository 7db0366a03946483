"""Token counts at every prefix against the library."""

import random

import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import tokens  # noqa: E402
from prismark.llm.queries import vocabulary  # noqa: E402

ODD = ["it's we'll DON'T can't!'s <|endoftext|> <|ENDOFTEXT|> x|y", "naïve café É İstanbul ŉ ß ΟΔΟΣ.", "日本語 テスト。123 4５６", "foo.bar,baz-(q)_x a1b2 12.5%", "x­s 😀 ²½ª", "  leading and trailing  \n", "aaaaaaaaaaaaaaa bbbbbbabab!!!!!!!???", "supercalifragilisticexpialidocious internationalization", "\x1c\x1d \x7f e\u0301"]


@pytest.fixture(scope="module")
def count():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    return lambda t: len(library.encode(t, add_special_tokens=False).ids)


def test_rows_of_words_by_the_merges(count):
    rng = random.Random(8)
    merges = tokens.Merges(vocabulary())
    words = ["".join(rng.choices("abcdeinorstth", k=rng.randint(1, 14))) for _ in range(150)] + ["".join(rng.choices("!#$%*+,-./:=?@_~", k=rng.randint(1, 8))) for _ in range(40)] + ["7", "the", "zzzzzzzzzz", "aaaaaaaaaaaa"]
    for w in words:
        assert merges.row(w) == [0, *(count(w[:k]) for k in range(1, len(w) + 1))], w


def test_counts_at_every_prefix(count, spark):
    encoder = tokens.Encoder.of(vocabulary())
    for t in ODD:
        assert [encoder.at(t, k) for k in range(len(t) + 1)] == [count(t[:k]) for k in range(len(t) + 1)]
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (50, ""), (50, "")]
    got = tokens.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary()).collect()
    assert sorted(((r.doc_id, r.counts) for r in got), key=str) == sorted(((i, [count((t or "")[:k]) for k in range(len(t or "") + 1)]) for i, t in rows), key=str)


@pytest.mark.parametrize("limit", [1, 7, 20])
def test_query_against_the_library(count, spark, limit):
    rng = random.Random(limit)
    texts = [*ODD, None, "", "word " * 3000, *(" ".join(rng.choices(["internationalization", "naïve", "a", "b!!c", "x9y8", "don't"], k=rng.randint(1, 60))) for _ in range(40))]
    rows = [(k if k % 11 else None, t, 1, "clash") for k, t in enumerate(texts)]
    rows += rows[:5]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, counts string").repartition(3)
    got = tokens.token_counts(d, vocabulary(), limit=limit).collect()
    within = lambda t: max(k for k in range(len(t) + 1) if count(t[:k]) <= limit) if len(t) < 2000 else None
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > limit, within(t or "")) for i, t, *_ in rows]
    assert sorted(map(str, ((*r[:4], None if r[1] > 2000 else r[4]) for r in map(tuple, got)))) == sorted(map(str, want))


LONG = ["日本語テスト。", "中文字符", "한국어", "ไทย", "ÀÉÎÕÜ", "ßſİ", "१२३", "٣٤", "😀👍🏽", "e\u0301", "été", "ПРИВЕТ", "x", "AB", "12", "---", "\u3000", "\u00a0", "«»", "\u0301"]


def test_rows_of_any_characters(count):
    rng = random.Random(3)
    encoder, by_bytes = tokens.Encoder.of(vocabulary()), 0
    for _ in range(120):
        piece = "".join(rng.choice(rng.choice(LONG)) for _ in range(rng.randint(1, 40)))
        want = [count(piece[:k]) for k in range(len(piece) + 1)]
        assert encoder.row(piece) == want, piece
        got = encoder._row_by_bytes(piece)
        assert got is None or got == want
        by_bytes += got is not None
    assert by_bytes > 40
    for piece in ("ΟΔΟΣΑ", "été's", "l'reé", "é<|endoftext|>é", "é\x1cé", "e\u0301a"):
        assert encoder.row(piece) == [count(piece[:k]) for k in range(len(piece) + 1)], piece


def test_very_long_pieces_are_not_encoded_again(count):
    import time

    rng = random.Random(5)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) if rng.random() < 0.97 else "。" for _ in range(100_000))
    encoder = tokens.Encoder.of(vocabulary())
    began = time.perf_counter()
    row = encoder._row_by_bytes(text)
    assert time.perf_counter() - began < 60 and len(row) == 100_001 and row[-1] == count(text)
    for k in (1, 2, 999, 5_000, 54_321):
        assert row[k] == count(text[:k])
    within = max(k for k, n in enumerate(row) if n <= 2048)
    assert count(text[:within]) <= 2048 < count(text[: within + 1])


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string"), vocabulary()).count() == 0
