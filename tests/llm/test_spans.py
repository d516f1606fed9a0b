import random
from collections import defaultdict

import pytest

from gridloom.llm import spans

SCHEMA = "doc_id bigint, text string"


def brute(docs, n):
    holders = defaultdict(set)
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            holders[t[k : k + n]].add(d)
    out = set()
    for d, t in docs:
        run = None
        for p in range(len(t or "") + 1):
            inside = p < len(t or "") and any(len(holders[t[k : k + n]]) > 1 for k in range(max(0, p - n + 1), min(p, len(t) - n) + 1))
            if inside and run is None:
                run = p
            elif not inside and run is not None:
                out.add((d, run, p))
                run = None
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n_docs, alphabet):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    adverts = [word(rng.randint(15, 60)) for _ in range(5)]
    docs = [(k, word(rng.randint(0, 120))) for k in range(n_docs)]
    for k in range(n_docs):
        d, t = docs[k]
        for _ in range(rng.randint(0, 3)):
            a = list(rng.choice(adverts))
            for _ in range(rng.randint(0, 2)):
                a[rng.randrange(len(a))] = rng.choice(alphabet)
            at = rng.randint(0, len(t))
            t = t[:at] + "".join(a) + t[at:]
        docs[k] = (d, t)
    return docs + [(n_docs, docs[0][1]), (n_docs + 1, docs[1][1] * 2), (n_docs + 2, None), (n_docs + 3, ""), (n_docs + 4, " " * 50)]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij\n é😀ß"])
def test_spans_against_brute_force(spark, alphabet):
    docs = corpus(len(alphabet), 40, alphabet)
    df = spark.createDataFrame(docs, SCHEMA)
    assert got(spans.shared_spans(df, 20, 8)) == brute(docs, 20)


def test_repeat_within_one_document_does_not_count(spark):
    docs = [(1, "xyzzy plugh quux " * 5), (2, "nothing of the kind"), (3, None)]
    assert got(spans.shared_spans(spark.createDataFrame(docs, SCHEMA), 12, 5)) == set()


def test_long_texts_are_cut_in_pieces(spark):
    docs = corpus(5, 20, "abcdefgh")
    docs += [(100, "".join(t or "" for _, t in docs))]
    df = spark.createDataFrame(docs, SCHEMA)
    assert set(spans._anchors(df, 8, 20, most=64).collect()) == set(spans._anchors(df, 8, 20).collect())
    assert got(spans.shared_spans(df, 20, 8)) == brute(docs, 20)


def test_one_advert_in_many_documents(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    advert, places = word(400), {}
    docs = []
    for d in range(300):
        before = word(rng.randint(0, 300))
        places[d] = len(before)
        docs.append((d, before + advert + word(rng.randint(0, 300))))
    seen, merge = [], spans.merge_spans
    monkeypatch.setattr(spans, "merge_spans", lambda s: merge(seen.append(s) or s))
    found = got(spans.shared_spans(spark.createDataFrame(docs, SCHEMA)))
    assert len(found) == 300 and all(a <= places[d] and b >= places[d] + 400 for d, a, b in found)
    assert seen[0].count() <= 300 * 400 / 64  # no more than one for each anchor of a document


@pytest.mark.parametrize("min_span, k", [(1, 1), (9, 9), (300, 20)])
def test_other_lengths(spark, min_span, k):
    docs = corpus(7, 12, "abc")
    docs += [(50, "abcde" * 100), (51, "x" + "abcde" * 99)]
    assert got(spans.shared_spans(spark.createDataFrame(docs, SCHEMA), min_span, k)) == brute(docs, min_span)


def test_empty_clashing_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(spans.shared_spans(empty, 20, 8)) == set()
    text = "one two three four five six seven"
    rows = [(1, text, "x", 1), (1, text, "y", 2), (2, "- " + text, "z", 3), (None, text, "n", 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, hash string, start int")
    found = spans.shared_spans(df, 20, 8)
    assert got(found) == {(1, 0, 33), (2, 2, 35)}
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in spans.shared_share(df, found).collect()}
    assert share == {1: (33, 33), 2: (35, 33)}


def test_bad_gram_length(spark):
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([], SCHEMA), 10, 11)
