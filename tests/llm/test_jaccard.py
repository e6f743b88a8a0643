import random
import re

import pytest

from ferrovia.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k):
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def made_rows(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for _ in range(n):
        kind = r.random()
        if rows and kind < 0.45:  # a copy with some edits
            words = r.choice(rows)[1].split(" ")
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                at = r.randrange(len(words) + 1)
                words[at : at + r.randint(0, 1)] = [r.choice(vocabulary)] * r.randint(0, 1)
        else:
            words = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 8, 12, 20, 40, 90, 300]))]
            if r.random() < 0.3:
                words = passage + words
        rows.append((len(rows), " ".join(words)))
    rows += [(9000, None), (9001, ""), (9002, " \t\n"), (9003, "one"), (9004, "ONE"), (None, "one"), (9003, "one"), (None, "nothing else")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 70)])
def test_components_equal_brute_force(spark, k, percent):
    rows = made_rows(k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard.near_duplicates(docs, k, percent).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, k, percent)


@pytest.mark.parametrize("most", [1 << 25, 2000])
def test_small_chunks_give_the_same(spark, monkeypatch, most):
    rows = made_rows(11)
    monkeypatch.setattr(jaccard, "CHUNK", 400)
    monkeypatch.setattr(jaccard, "MOST_IN_COMPONENT", most)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs, 3, 90).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 3, 90)


def test_search_gives_every_link_when_asked():
    import numpy as np

    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 100).astype(np.uint64)
    sets = []
    for _ in range(60):
        x = base.copy()
        x[r.integers(0, 100, int(r.integers(0, 14)))] = r.integers(0, 1 << 60)
        sets.append(np.unique(x[: int(r.integers(80, 101))]))
    sets.sort(key=len)
    for percent in (80, 90):
        wanted = set()
        for i in range(60):
            for j in range(i + 1, 60):
                inter = len(np.intersect1d(sets[i], sets[j]))
                if 100 * inter >= percent * (len(sets[i]) + len(sets[j]) - inter):
                    wanted.add((i, j))
        assert wanted and set(jaccard.search(sets, percent, spanning=False)) == wanted
        across = {(i, j) for i, j in wanted if i < 30 <= j}
        assert set(jaccard.search(sets, percent, split=30, spanning=False)) == across


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int, set_id string")
    assert jaccard.near_duplicates(docs).collect() == []


def test_long_texts_clashing_columns_and_thue_morse_words(spark):
    parity = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[x ^ flip] for x in parity) for flip in (0, 1)]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, words[0]), (2, words[1]), (3, f"{words[0]} x y z"), (4, f"{words[1]} x y z"), (5, long), (6, long + " end"), (7, long.replace("w3 ", "")), (8, words[0]), (9, None)]
    clash = spark.createDataFrame([(*r, 7, "s", 1, 2, "c", b"h") for r in rows], "doc_id long, text string, n int, set_id string, component_id int, part int, leader string, hashes binary")
    got = jaccard.near_duplicates(clash, 3, 90).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 3, 90)


def test_hot_parts_are_counted_alike(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLED", 1)
    monkeypatch.setattr(jaccard, "HOT", 3)
    rows = made_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert jaccard.hot_parts(docs, 3, 90) is not None
    got = jaccard.near_duplicates(docs, 3, 90).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 3, 90)


def test_copies_of_one_text_are_joined_without_meeting_each_other(spark, monkeypatch):
    """Near copies of a text in a block too large for one task: one round joins nearly all, and what is left meets them; still exact."""
    import random

    r = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice((1, 1, 1, 2, 4))):
            words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard, "CHUNK", 1000)
    monkeypatch.setattr(jaccard, "MOST_IN_COMPONENT", 2000)
    seen = []
    plain = jaccard._joined

    def told(*x):
        led, links = plain(*x)
        seen.append((led.count(), led.where("group = 0").count(), led.select("group").distinct().count()))
        return led, links

    monkeypatch.setattr(jaccard, "_joined", told)
    got = jaccard.near_duplicates(docs, 3, 90).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 3, 90)
    ((every, left, groups),) = seen
    assert every >= 100 and groups > 1 and left < every
    assert jaccard.set_links(docs, 3, 90, spanning=False).count() > 1000  # all links still come when asked for, and by no round
    assert len(seen) == 1


def test_near_copies_that_share_most_lists_are_searched_by_counts():
    """900 sets that share most of their shingles: a heap merged nearly all of them for each one."""
    import time

    import numpy as np

    r = np.random.default_rng(8)
    base = r.integers(0, 1 << 60, 150).astype(np.uint64)
    sets = []
    for i in range(900):
        x = base.copy()
        x[r.choice(150, int(r.integers(0, 24)), replace=False)] = i
        sets.append(np.unique(x))
    sets.sort(key=len)
    began = time.process_time()
    found = jaccard.search(sets, 90)
    every = set(jaccard.search(sets, 90, spanning=False))
    took = time.process_time() - began
    held = np.array([np.isin(np.append(base, np.arange(900, dtype=np.uint64)), x) for x in sets]).astype(int)
    both, sizes = held @ held.T, np.array([len(x) for x in sets])
    wanted = np.argwhere(np.triu(100 * both >= 90 * (sizes[:, None] + sizes - both), 1))
    assert every == {tuple(x) for x in wanted.tolist()} and every.issuperset(found)
    label, joined = np.arange(900), np.arange(900)
    for links, of in ((wanted.tolist(), label), (found, joined)):
        for i, j in links:
            of[of == of[j]] = of[i]
    assert len(set(label.tolist())) == len(set(joined.tolist())) == 900 - len(found)
    assert took < 4


def test_links_that_are_settled_take_no_round(spark, monkeypatch):
    from ferrovia.llm import components

    def star(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(components, "_star", star)
    links = spark.createDataFrame([(i // 40 * 40, i) for i in range(200) if i % 40] * 2, "a long, b long").repartition(6)
    assert {tuple(x) for x in components.components(links).collect()} == {(i, i // 40 * 40) for i in range(200)}
