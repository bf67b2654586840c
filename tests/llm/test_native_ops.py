"""Sharding, decontamination, mixing and license votes."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from summarium.llm import license_votes as L
from summarium.llm import poisson_mix as P
from summarium.llm import spaced_seeds as S
from summarium.llm import virtual_slots as V

# ---------------------------------------------------------------- sharding


def test_shards_are_even_and_positions_gapless(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    versions, stats = V.balanced_map(docs, 8)
    rows = V.positions(docs, versions[-1], stats).collect()
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == docs.count() and set(load) == set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(load.values()) - min(load.values()) <= max(len(t.encode()) + 1 for t in texts.values())
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8


def test_edit_moves_only_from_full_shards(spark):
    sizes = {s: (s * 7919) % 101 + 1 for s in range(256)}
    first = V.initial_map(4, 256)
    grown = V.edit_map(first, sizes, 5)
    moved = [s for s in range(256) if grown[s] != first[s]]
    load = Counter()
    for s, shard in enumerate(grown):
        load[shard] += sizes[s]
    assert moved and max(load.values()) - min(load.values()) <= 101
    assert V.edit_map(grown, sizes, 5) == grown or len(
        [s for s in range(256) if V.edit_map(grown, sizes, 5)[s] != grown[s]]) < len(moved)
    shrunk = V.edit_map(grown, sizes, 3)
    assert set(shrunk) == {0, 1, 2}


def test_map_versions_are_stored(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x" * i) for i in range(50)])
    versions, stats = V.balanced_map(docs, 3, slots=16)
    path = f"file://{tmp_path}/map"
    V.write_map(spark, versions, stats, path)
    assert V.read_map(spark, path) == versions[-1] and V.read_map(spark, path, 0) == versions[0]
    V.write_shards(docs, versions[-1], f"file://{tmp_path}/out", files_per_shard=2)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 50


def test_stored_map_is_edited_when_rebalancing(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/map"
    docs = V.slotted(make_docs([(i, "x" * (i % 90)) for i in range(400)]))
    stats = V.slot_stats(docs)
    first = V.stored_map(spark, stats, 4, path)
    assert V.read_map(spark, path, 0) == V.initial_map(4) and first == V.read_map(spark, path, 1)
    assert V.stored_map(spark, stats, 4, path) == first or len(os.listdir(tmp_path / "map")) <= 4
    grown = V.stored_map(spark, stats, 5, path)
    load = Counter()
    for slot, shard in enumerate(grown):
        load[shard] += stats.get(slot, (0, 0))[0]
    assert set(load) == set(range(5)) and max(load.values()) - min(load.values()) <= 91
    assert sum(a != b for a, b in zip(first, grown)) < V.SLOTS / 2


def test_rows_without_id_share_no_slot(spark, make_docs):
    docs = V.slotted(make_docs([(None, "equal text")] * 3000 + [(i, "y") for i in range(100)]))
    assert docs.where("doc_id is null").groupBy("virtual_slot").count().agg({"count": "max"}).first()[0] < 20
    versions, stats = V.balanced_map(docs, 8)
    rows = V.positions(docs, versions[-1], stats).collect()
    load, slots = Counter(), defaultdict(list)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == 3100 and max(load.values()) - min(load.values()) <= 40
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shard_odd_rows(odd_docs, no_docs):
    versions, stats = V.balanced_map(odd_docs, 8)
    rows = V.positions(odd_docs, versions[-1], stats).collect()
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if r.doc_id in (1, 2)} == {1}
    assert V.assign(odd_docs, versions[-1]).columns == odd_docs.columns + ["virtual_slot", "shard"]
    versions, stats = V.balanced_map(no_docs, 8)
    assert V.positions(no_docs, versions[-1], stats).count() == 0

# ---------------------------------------------------------------- mixing


def brute_copies(key, rate):
    u = int(hashlib.md5(f"{P.SEED}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, c = 0, math.exp(-rate)
    p = c
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_copies_are_the_inverted_poisson(make_docs):
    rows = [(i, "x" * (i % 50), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    docs = make_docs(rows)
    rates = {r.source: r.rate for r in P.source_rates(docs).collect()}
    got = Counter(r.doc_id for r in P.mix(docs).collect())
    assert got == Counter({i: n for i, _, s in rows if (n := brute_copies(i, rates[s]))})


def test_target_weights_and_large_rates(spark, make_docs):
    docs = make_docs([(i, "abcd", "big" if i else "small") for i in range(2000)])
    w = spark.createDataFrame([("small", 0.5), ("big", 0.5)], "source string, weight double")
    got = Counter(r.source for r in P.mix(docs, w).collect())
    assert abs(got["small"] - 1000) < 200 and abs(got["big"] - 1000) < 200
    none = spark.createDataFrame([("big", 1.0)], "source string, weight double")
    assert {r.source for r in P.mix(docs, none).select("source").distinct().collect()} == {"big"}


def test_mix_odd_rows(odd_docs, no_docs):
    out = P.mix(odd_docs, epochs=3.0)
    assert out.columns == odd_docs.columns + ["copy", "shuffle_key"]
    n = Counter((r.doc_id, r.text) for r in out.collect())
    assert n[(7, "same row")] % 2 == 0
    assert P.mix(no_docs).count() == 0

# ---------------------------------------------------------------- decontamination


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, ITEM), (2, "too short to look for"), (3, None), (4, ""), (1, ITEM), (5, "w " * 40)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("w", F.lit(1))


def found(docs, bench):
    return {(r.doc_id, r.item_id) for r in S.contaminated(docs, bench).collect()}


def test_finds_exact_cased_and_substituted_passages(make_docs, bench):
    w = ITEM.split()
    one = w[:5] + ["OTHER"] + w[6:]
    two = w[:3] + ["x"] + w[4:10] + ["y"] + w[11:]
    many = [x if i % 2 else "z" for i, x in enumerate(w)]
    docs = make_docs([(1, "start " + ITEM + " end"), (2, "Some, " + ITEM.upper().replace(" ", ", ") + "!"),
                      (3, " ".join(one)), (4, " ".join(two)), (5, " ".join(many)),
                      (6, " ".join(w[:9]) + " then it goes elsewhere with other words and more words"),
                      (7, " ".join(reversed(w))), (8, None), (9, ""), (1, "no leak under the same id"),
                      (None, ITEM), (10, "w " * 41)])
    assert found(docs, bench) == {(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (10, 5)}
    kept = S.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in kept.select("doc_id", "text").collect()) == [
        (1, "no leak"), (5, "z beta "), (6, "alpha b"), (7, "pi omic"), (8, ""), (9, "")]


def test_large_benchmark_joins_by_shuffle(make_docs, bench, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_SEEDS", 0)
    assert found(make_docs([(1, ITEM), (2, "clean")]), bench) == {(1, 1)}


def test_decontaminate_odd_rows(odd_docs, no_docs, bench):
    assert found(odd_docs, bench) == set()
    assert S.decontaminate(odd_docs, bench).count() == odd_docs.count()
    assert found(no_docs, bench) == set() and found(odd_docs, bench.limit(0)) == set()
    assert {r.item_id for r in S.short_items(bench).collect()} == {3, 4}


def test_every_placing_of_the_substitutions_is_found(spark, make_docs):
    """Items of 4 to 16 words: found with as many words changed as the rule allows,
    wherever they are, and not with one more."""
    items, docs, want = [], [], set()
    for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16):
        w = [f"n{n}w{i}" for i in range(n)]
        items.append((n, " ".join(w)))
        width = min(n, S.WINDOW)
        allowed = 0 if n < S.WHOLE else width - math.ceil(S.MATCH * width)
        for changed in itertools.combinations(range(n), allowed):
            want.add((len(docs), n))
            docs.append((len(docs), "before it " + " ".join("x" if i in changed else x for i, x in enumerate(w)) + " after"))
        # no 13 consecutive words hold so few
        for changed in itertools.combinations(range(n - width, width), allowed + 1):
            docs.append((len(docs), "before it " + " ".join("x" if i in changed else x for i, x in enumerate(w)) + " after"))
    assert found(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")) == want

# ---------------------------------------------------------------- licenses


def scanned(df):
    return {r.doc_id: r for r in L.scan_documents(df).collect()}


def test_license_labels_and_places(make_docs):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit = dict(L.NOTICES and [(x[1], x[0]) for x in L.NOTICES])["mit-text"].split()
    changed = " ".join(mit[:20] + ["extra", "words"] + mit[20:])
    got = scanned(make_docs([
        (1, "Text. Released under the MIT License. MIT license mit\nLICENSE"), (2, gpl),
        (3, "the apache and the license are not one; mit-licenses neither"),
        (4, "Licensed under CC BY-NC 4.0."), (5, changed), (6, "apache license"), (7, "mit  --  license!")]))
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (3, 4, 8)
    assert got[1].base_labels == "mit" and got[1].labels == "mit,mit-notice"
    assert got[2].base_labels == "gpl" and got[2].labels == "gpl,gpl-3.0" and got[2].first_word == 7
    assert got[3].n_base == 0 and got[3].labels == "" and got[3].score == 0.0 and got[3].first_word is None
    assert got[4].labels == "cc-by-nc-4.0" and got[4].base_labels == ""
    assert got[5].labels == "mit-text" and 0.6 <= got[5].score <= 1
    assert got[6].n_base == 1 and got[6].n_words == 2 and got[7].n_base == 1


def test_license_odd_rows(odd_docs, no_docs):
    rows = L.scan_documents(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(r.doc_id == 7 for r in rows) == 2
    by = {r.doc_id: r for r in rows}
    assert by[1].n_words == by[2].n_words == 0 and by[4].n_words == 1 and by[5].n_words == 24_000
    assert L.scan_documents(no_docs).count() == 0


def test_many_copies_of_one_row_count_once_each(make_docs):
    rows = scanned(make_docs([(1, "under the mit license")] * 5))
    assert rows[1].n_base == 1 and L.scan_documents(make_docs([(1, "mit license")] * 5)).count() == 5


@pytest.mark.parametrize("build", [lambda d, b: L.scan_documents(d), lambda d, b: S.contaminated(d, b),
                                   lambda d, b: P.mix(d)])
def test_native_plans_hold_no_python(make_docs, bench, build):
    plan = build(make_docs([(1, ITEM + " mit license")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
