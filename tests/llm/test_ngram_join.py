"""Links and components against brute force."""

import random

import numpy as np
import pytest

from summarium.llm import ngram_join as J

CONTRACT = {"k": 4, "percent": 85}


def brute(rows):
    """{position: (n_shingles, smallest reachable id, links)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), links[i]))
    return sorted(out, key=repr)


def result(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in df.collect()], key=repr)


def corpus(seed, n=60):
    """Random texts, copies, and chains of edited copies of many lengths."""
    rnd = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                at = rnd.randrange(len(w))
                w[at:at + rnd.choice([0, 1])] = [rnd.choice(["x", "y", "zz"])] * rnd.choice([0, 1])
                w = w or ["x"]
            text = " ".join(w)
        else:
            text = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.choice([1, 2, 4, 9, 40, 90, 150])))
        texts.append(text)
        rows.append((rnd.randrange(10_000), text if rnd.random() < 0.9 else text.upper()))
    return rows


@pytest.mark.parametrize("seed, task_shingles", [(0, J.TASK_SHINGLES), (1, 100), (2, 1)])
def test_matches_brute_force(make_docs, seed, task_shingles):
    rows = corpus(seed)
    assert result(J.linked_documents(make_docs(rows), task_shingles=task_shingles, **CONTRACT)) == brute(rows)


def test_large_block_is_cut_in_chunks(make_docs):
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(50):
        w = list(base)
        w[rnd.randrange(80)] = f"e{i}"
        rows.append((i, " ".join(w)))
    assert result(J.linked_documents(make_docs(rows), task_shingles=600, **CONTRACT)) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    from .conftest import ODD
    got = {(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in J.linked_documents(odd_docs).collect()}
    assert {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (4, 1, 4, 0), (7, 1, 7, 1), (8, 0, 8, 0)} <= got
    assert (None, 1, None, 0) in got
    assert J.linked_documents(odd_docs).count() == len(ODD)
    assert J.linked_documents(no_docs).count() == 0


def test_keep_one(make_docs, no_docs):
    a = " ".join(f"w{i}" for i in range(60))
    b = a.replace("w30", "zz")
    df = make_docs([(5, a), (3, b), (9, a), (9, a), (4, "other words here now"), (4, "other words here now"),
                    (6, None), (7, None), (None, "loose text")])
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.select("doc_id").collect()], key=repr) == [3, 4, 6, 7, None]
    assert J.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_signatures_lose_no_link(seed):
    """Any two sets at the threshold share a part signature."""
    rnd = random.Random(seed)
    for _ in range(60):
        n = rnd.choice([1, 2, 3, 5, 6, 7, 8, 13, 16, 17, 31, 40, 64, 65, 100, 300, 900, 2500])
        common = [rnd.getrandbits(64) for _ in range(n)]
        spare = int(n / 0.85) - n
        x = rnd.randint(0, spare)
        a = np.unique(np.array(common + [rnd.getrandbits(64) for _ in range(x)], np.uint64))
        b = np.unique(np.array(common + [rnd.getrandbits(64) for _ in range(spare - x)], np.uint64))
        assert 100 * n >= 85 * (n + spare)
        assert set(J.signatures(a, 85).tolist()) & set(J.signatures(b, 85).tolist())


def test_heap_and_counting_merge_alike(monkeypatch):
    rnd = random.Random(1)
    lists = [np.unique(np.array([rnd.randrange(40) for _ in range(rnd.randint(0, 12))], np.int64)) for _ in range(9)]
    heap = J.merge_counts(lists, 40)
    monkeypatch.setattr(J, "HEAP_ENTRIES", -1)
    count = J.merge_counts(lists, 40)
    assert all(np.array_equal(a, b) for a, b in zip(heap, count))
