"""Substring dedup against a brute force of its own: words, sentences and spans in plain Python, equal spans by their words."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallysheet.llm import spans

MIN_WORDS, RUN, EVERY = 25, 3, 4


def brute_sentences(words):
    """[start, end) of each sentence, by the rule as it is stated."""
    out, at = [], 0
    for i, w in enumerate(words):
        bare = w.rstrip("\"')]»”") if w[-1] in "\"')]»”" and len(w) - len(w.rstrip("\"')]»”")) == 1 else w
        if bare[-1:] in (".", "!", "?") or (i and w == words[i - 1]) or xxhash.xxh3_64_intdigest(w.encode()) % EVERY == 0 or i == len(words) - 1:
            out.append((at, i + 1))
            at = i + 1
    return out


def brute_spans(text):
    words = (text or "").lower().split()
    own, out = brute_sentences(words), []
    for i in range(len(own)):
        for j in range(i + RUN - 1, len(own)):
            if own[j][1] - own[i][0] >= MIN_WORDS:
                out.append((tuple(words[own[i][0] : own[j][1]]), own[i][0], own[j][1]))
                break
    return out


def brute(rows):
    """The words that stay of each row."""
    places = {}
    for i, t, *_ in rows:
        if i is not None:
            for s, a, _ in brute_spans(t):
                places.setdefault(s, set()).add((i, a))
    out = []
    for i, t, *_ in rows:
        words = (t or "").split()
        gone = set()
        for s, a, b in brute_spans(t) if i is not None else ():
            first = min(places[s])
            if first != (i, a):
                gone |= set(range(max(a, first[1] + b - a) if first[0] == i else a, b))
        out.append((i, None if t is None else tuple(w for k, w in enumerate(words) if k not in gone)))
    return out


def say(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("held", [500_000, 10])
def test_against_brute_force(spark, docs, rows, empty, held, monkeypatch):
    monkeypatch.setattr(spans, "HELD", held)
    got = spans.drop_repeats(docs.withColumn("n_removed", F.lit("old")).withColumn("hashes", F.lit(1))).collect()
    words = lambda t: None if t is None else tuple(t.split())
    assert sorted(((r["doc_id"], words(r["text"])) for r in got), key=repr) == sorted(brute(rows), key=repr)
    assert sum(r["n_removed"] for r in got) > 0 and {r["hashes"] for r in got} == {1}
    for r in got:
        t = next(t for i, t, *_ in rows if i == r["doc_id"])
        left = t
        for a, b in reversed(r["removed_spans"]):
            left = left[:a] + left[b:]
        assert left == r["text"]
    assert spans.drop_repeats(empty).count() == 0


def test_random_copies(spark):
    r = random.Random(3)
    for _ in range(3):
        pool = [" ".join(say(r, r.randint(1, 14)) + r.choice([".", "!", ".)", ""]) for _ in range(8)) for _ in range(4)]
        rows = [(i, " ".join(r.choice([r.choice(pool), say(r, r.randint(1, 20)), " ".join(r.choice(pool).split()[3:])]) for _ in range(r.randint(1, 5)))) for i in range(30)]
        got = spans.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert {x["doc_id"]: tuple(x["text"].split()) for x in got} == dict(brute(rows))


def test_passage_of_over_50_words_is_found_wherever_it_begins():
    r, caught, left_over = random.Random(9), 0, []
    for _ in range(300):
        sizes = [r.randint(3, 20) for _ in range(6)]
        words = " ".join(say(r, n) + "." for n in sizes).split()
        passage = words[(k := r.randint(0, 8)) : k + r.randint(51, 60)]
        if len(passage) < 51:
            continue
        put = lambda: " ".join([*say(r, r.randint(0, 40)).split(), *passage, *say(r, r.randint(1, 40)).split()])
        a, b = put(), put()
        h, first, *_ = spans.spans(b)
        in_a = np.isin(h, spans.spans(a)[0])
        left, n, _ = spans.without(b, h[in_a], first[in_a])
        caught += n > 0
        left_over.append(len(set(passage) & set(left.split())))
        assert set(b.split()) - set(passage) <= set(left.split())
    assert caught >= 0.99 * len(left_over) and np.mean(left_over) < 10


def test_without_marks_and_by_any_white_space():
    r = random.Random(11)
    passage = [f"v{r.randrange(10**9)}" for _ in range(80)]
    h, a, *_ = spans.spans(" ".join([*say(r, 40).split(), *passage, *say(r, 50).split()]))
    for offset in range(31):
        for gap in (" ", "  ", "\t", "\n", " \t "):
            text = gap.join([*say(r, offset).split(), *passage, *say(r, 40).split()])
            own, first, *_ = spans.spans(text)
            hit = np.isin(own, h)
            left = spans.without(text, own[hit], first[hit])[0].split()
            assert len(set(left) & set(passage)) < 25


def test_overlapping_repeat_leaves_the_first():
    for period in (1, 3, 17):
        rows = [(1, " ".join(f"w{i % period}." for i in range(500)))]
        h, a, *_ = spans.spans(rows[0][1])
        seen = {}
        later = np.array([seen.setdefault(x, i) != i for x, i in zip(h.tolist(), a.tolist(), strict=True)])
        left = spans.without(rows[0][1], h[later], a[later])[0].split()
        assert tuple(left) == brute(rows)[0][1] and 25 <= len(left) <= 25 + period


def test_very_long_text(spark):
    r = random.Random(12)
    long = say(r, 200_000)
    got = {x["doc_id"]: x["text"] for x in spans.drop_repeats(spark.createDataFrame([(1, long), (2, "before " + long + " after")], "doc_id long, text string")).collect()}
    assert got[1] == long and len(got[2].split()) < 60
