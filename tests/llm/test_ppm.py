"""Code lengths against a plain model with exclusion; languages of texts; letters by category."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("prismark.llm")

from prismark.llm import ppm  # noqa: E402


class Plain:
    """Prediction by partial matching as it is told in words: one dictionary of counters."""

    def __init__(self, texts, order):
        self.order, self.seen = order, {}
        for text in texts:
            full = b"\0" * order + text
            for k in range(order, len(full)):
                for o in range(order + 1):
                    self.seen.setdefault(full[k - o : k], Counter())[full[k]] += 1

    def cost(self, text):
        full, out = b"\0" * self.order + text, 0.0
        for k in range(self.order, len(full)):
            excluded = set()
            for o in range(self.order, -1, -1):
                here = {s: n for s, n in self.seen.get(full[k - o : k], {}).items() if s not in excluded}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if full[k] in here:
                    out -= np.log(here[full[k]] / whole)
                    break
                out -= np.log(len(here) / whole)
                excluded |= set(here)
            else:
                out += np.log(256 - len(excluded))
        return out


@pytest.mark.parametrize("order", [1, 2, 4])
def test_code_lengths_against_a_plain_model(order):
    rng = random.Random(order)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 6)))
    texts = {"aa": [" ".join(word("abcé") for _ in range(30)).encode() for _ in range(5)], "bb": [" ".join(word("bcdxyz") for _ in range(20)).encode() for _ in range(4)]}
    counts = {}
    for lang, many in texts.items():
        buf, offsets = np.frombuffer(b"".join(many), np.uint8), np.cumsum([0, *map(len, many)])
        counts[lang] = np.unique(ppm.grams(buf, offsets, order), return_counts=True)
    trees = ppm.Trees(counts, {"aa": 5, "bb": 4}, order)
    plain = [Plain(texts[x], order) for x in trees.languages]
    asked = [b"", b"abc bcd", "é日本".encode(), b"zzzz aaaa\0\xff", texts["aa"][0], b"q", *[word("abcdexyz \n").encode() for _ in range(40)]]
    buf, offsets = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])
    assert np.allclose(trees.code_lengths(buf, offsets), [[m.cost(t) for m in plain] for t in asked], rtol=1e-5, atol=1e-4)


def test_languages_of_made_up_texts(spark):
    rng = random.Random(2)
    words = {"xx": ["the", "thing", "with", "other"], "yy": ["der", "schön", "über", "nicht"]}
    rows = [(k, " ".join(rng.choices(words[x], k=30)), x) for k in range(120) for x in (("xx", "yy")[k % 2],)]
    odd = [None, "123 !?", "", "²½", "Ⅷ ①", "\u0301", "_", "  \n"]  # none has a letter
    rows += [(500 + k, t, "xx") for k, t in enumerate(odd)] + [(600, "ÜBER", None), (600, "ÜBER", None), (None, "schön über", None), (601, "ª", None), (602, "der nicht " * 30000, None)]
    got = ppm.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by_id[k].lang_pred == x for k, _, x in rows[:120])
    assert [(by_id[500 + k].lang_pred, by_id[500 + k].score) for k in range(len(odd))] == [("und", 0.0)] * len(odd)
    assert by_id[None].lang_pred == by_id[602].lang_pred == "yy" and by_id[601].lang_pred in ("xx", "yy") and 0 <= by_id[600].score <= 1
    assert all(r.held_out == ppm.in_fold(r.doc_id, (5, 0)) for r in got if r.doc_id is not None)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, score double")
    assert ppm.identify_languages(d).count() == 0
    none = ppm.identify_languages(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
