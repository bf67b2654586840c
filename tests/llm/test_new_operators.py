"""Level products, harmonic packing and the position index, each against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from summarium.llm import harmonic_packing as H
from summarium.llm import level_products as V
from summarium.llm import position_index as P

# ---------------------------------------------------------------- level products


def brute_divergence(rows, min_docs, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    df, n = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        df[lang or ""].update(set(found))
        n[lang or "", source or ""].update(found)
    out = []
    for lang in df:
        kept = [t for t, c in df[lang].items() if c >= min_docs]
        groups = sorted(s for x, s in n if x == lang)
        held = {s: n[lang, s] for s in groups}
        whole = Counter()
        for c in held.values():
            whole.update(c)

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        table = {s: {t: p(held[s], t) for t in kept} for s in groups}
        q = {t: p(whole, t) for t in kept}
        for s in groups:
            pairs = [(sum(f(table[s][t], table[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(table[s][t], q[t]), t) for t in kept if held[s][t] and table[s][t] > q[t]]
            for part, found, last in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def random_rows(seed, n=160, sources=9):
    draw = random.Random(seed)
    words = [f"w{a}{b}" for a in "abcdef" for b in "éxyzÅ"] + ["文字", "Upper", "ÜBER"]
    rows = []
    for _ in range(n):
        source = f"s{min(draw.randrange(sources), draw.randrange(sources))}"
        k = draw.choice([0, 3, 30, 60])
        rows.append((draw.choice(["en", "de", None]), source,
                     ", ".join(draw.choices(words, [1 / (i + 1) for i in range(len(words))], k=k))))
    return rows + [("fr", "only", "1 2 3"), ("fr", None, None), ("en", "s1", "x" * 5000 + " wa " * 900)]


@pytest.mark.parametrize("terms, groups", [(4, 4), (256, 32)])
def test_divergence_equals_brute_force(spark, terms, groups):
    rows = random_rows(1)
    df = spark.createDataFrame([(i, t, x, s, "clash") for i, (x, s, t) in enumerate(rows)],
                               "doc_id long, text string, lang string, source string, total string")
    got = sorted(tuple(r) for r in V.divergence(df, min_docs=5, terms=terms, per_block=groups)
                 .select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute_divergence(rows, 5, V.TOP_TERMS)
    assert {(r[1], r[4]) for r in got if r[0] == "fr"} == {("only", 0), ("", 0)}


def test_priced_blocks_cover_all_tiles(monkeypatch):
    """The product in tiles of a few columns equals the sums term by term."""
    import pandas as pd

    monkeypatch.setattr(V, "TILE", 3)
    draw = random.Random(2)
    terms, groups = 40, 5
    p = np.array([[draw.choice([7, 7, 90, 10**9, 123456789]) for _ in range(groups)] for _ in range(terms)])
    cells = [(t, g, p[t, g]) for t in range(terms - 3) for g in range(groups) if p[t, g] != 7]
    p[terms - 3:] = 7
    info = pd.DataFrame({"lang": "x", "g": range(groups), "p0": 7, "n_terms": terms, "gi": 0, "gj": 0})
    got = V.priced_block(pd.DataFrame(cells, columns=["term", "g", "p"]), info)
    for _, g, h, value in got.itertuples(index=False):
        assert value == sum((a - b) ** 2 // (a + b) for a, b in zip(p[:, g].tolist(), p[:, h].tolist()))


def test_tally_hands_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(V, "TALLY_ENTRIES", 3)
    monkeypatch.setattr(V, "BATCH_TERMS", 2)
    texts = ["a b c", "a a", "c d é", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4), pa.array(["s", "t", "s", "t"]), pa.array(texts)],
                                       names=["lang", "source", "text"])
    n, docs = Counter(), Counter()
    for b in V._tally(iter([batch])):
        for r in b.to_pylist():
            docs[r["term"]] += r["docs"]
            for s, c in zip(r["sources"], r["counts"]):
                n[s, r["term"]] += c
    assert docs == {"a": 2, "b": 1, "c": 2, "d": 1, "é": 1}
    assert n == {("s", "a"): 1, ("s", "b"): 1, ("s", "c"): 2, ("t", "a"): 2, ("s", "d"): 1, ("s", "é"): 1}


def test_blocks_are_priced_once(spark):
    """Both ways of a pair come from one run of the blocks, and a sort by term needs no look at
    the whole row for every two terms of a language."""
    df = spark.createDataFrame([(i, t, x, s) for i, (x, s, t) in enumerate(random_rows(3))],
                               "doc_id long, text string, lang string, source string")
    counts = V.term_counts(df, 5)

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()
    pairs = V.pair_values(counts, V.group_table(df, counts), 4, 4)
    assert len(re.findall("FlatMapCoGroupsInPandas", plan(pairs))) == 1
    assert not re.search(r"Sort \[lang#", plan(counts)) and re.search(r"Sort \[term#", plan(counts))


def test_divergence_odd_rows(odd_docs, no_docs):
    assert {(r.source, r["value"]) for r in V.divergence(odd_docs.drop("n_chars")).collect() if r.part == "pair"} <= {
        ("s", 0), ("", 0)}
    assert V.divergence(no_docs).count() == 0

# ---------------------------------------------------------------- harmonic packing


@pytest.fixture(scope="module")
def tokenizer():
    return public_tokenizers.path("word_bpe_49k.json")


def brute_ids(tk, text):
    return tk.encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, packed, tk, capacity=2048):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in packed:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    left = Counter()
    for key, text in rows:
        left[key, tuple(brute_ids(tk, text))] += 1
    for key in {k for k, _ in rows}:
        pieces = Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in docs.pop(key))
        want = Counter()
        for (k, ids), n in left.items():
            if k == key:
                start = 0
                for length, _ in H.cut_lengths(len(ids), capacity):
                    raw = np.array(ids[start:start + length], "<u4").tobytes()
                    want[start, length, zlib.crc32(raw), len(ids)] += n
                    start += length
        assert pieces == want
    assert not docs
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    return sequences


def test_cut_lengths():
    for n in [*range(1, 5000), 123_457]:
        cut = H.cut_lengths(n)
        assert sum(x for x, _ in cut) == n
        assert all(0 <= 2048 - k * x < x and 2048 - k * x <= 46 for x, k in cut)
        assert len([x for x, _ in cut if x < 2016]) <= 4


def test_packing_keeps_every_id(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tk = Tokenizer.from_file(tokenizer)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    packed = H.pack(docs.repartition(5), tokenizer).collect()
    sequences = check_packing(rows, packed, tk)
    tokens = sum(r.length for r in packed)
    assert tokens > 0.97 * 2048 * (len(sequences) - 1)


def test_chunks_equal_the_tokenizer(tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    texts = ["It's JOHN'S 'quoted' don't, well-known.", "été É J̌İ İx İstanbul ΟΔΟΣ",
             "a b\u0085c d e", "x²½3 ÷ ×5 ÀÈß éa, à.b", "<|endoftext|> <|startoftext|>x a<|endoftext|>",
             "文字 \U0001f600ok 12345 a_b __ --", "...", " \t\n", "", "word" * 3000, "a'b' 's's 'll", "ÀÉ́ naïve. NAÏVE!"]
    known = H.ChunkIds(tokenizer, limit=8)
    for got, text in zip(known.ids([t.encode() for t in texts]), texts):
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids, text
    for text in texts:  # after the forgetting of chunks
        got = known.ids([text.encode()])[0]
        assert np.frombuffer(got, "<u4").tolist() == tk.encode(text, add_special_tokens=False).ids, text


def test_best_fit_wastes_little():
    draw = random.Random(4)
    lengths = [draw.randrange(1, 700) for _ in range(800)]
    bins = H.best_fit(lengths)
    load = Counter()
    for b, n in zip(bins, lengths):
        load[b] += n
    assert max(load.values()) <= 2048 and len(load) <= sum(lengths) / 2048 * 1.02 + 1


def test_packing_odd_rows(odd_docs, no_docs, tokenizer):
    tk = Tokenizer.from_file(tokenizer)
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    check_packing(rows, H.pack(odd_docs, tokenizer).collect(), tk)
    assert H.pack(no_docs, tokenizer).count() == 0

# ---------------------------------------------------------------- position index


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows, min_letters, min_count, slip):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= min_letters and c >= min_count}
    out, form = {}, {}
    for w in n:
        met = [x for x in n if near(w, x)]
        best = min(met, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= P.FORM_RATIO * n[w] else None
        out[w] = len(met)
    rows = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n.get(form[w])))
    return rows


def typo_rows(seed, n=300):
    draw = random.Random(seed)
    letters = "abcé"
    base = ["".join(draw.choices(letters, k=draw.randrange(3, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        words = []
        for w in draw.choices(base, [1 / (i + 1) for i in range(len(base))], k=40):
            if draw.random() < 0.1:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1:], w[:at] + draw.choice(letters) + w[at:],
                                 w[:at] + draw.choice(letters) + w[at + 1:]])
            words.append(w.capitalize() if draw.random() < 0.1 else w)
        rows.append((i if i % 50 else None, "; ".join(words)))
    return rows


@pytest.mark.parametrize("block", [5, 64, 4096])
def test_variants_equal_brute_force(spark, block):
    rows = typo_rows(3)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string").repartition(3)
    got = P.spelling_variants(df, min_letters=3, min_count=2, slip=7, block=block)
    want = brute_variants(rows, 3, 2, 7)
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 300 and any(r[1] and r[2] != r[1] for r in want)


def test_block_counts_each_pair_once():
    """All words over two letters: both halves agree for many pairs."""
    words = [f"{x:0{m}b}".translate(str.maketrans("01", "ab")) for m in (4, 5) for x in range(1 << m)]
    every = P._packed(np.ones((len(words), len(words)), bool))
    found = P.near_in_block(words, 4, None, every)
    for i, w in enumerate(words):
        bits = {words[j] for j in range(len(words)) if found[i, j // 64] >> np.uint64(j % 64) & np.uint64(1)}
        assert bits == {x for x in words if near(w, x) and not len(x) == len(w) == 5}


def test_block_of_many_buckets_holds_few_sets():
    """A block of the largest size is searched in parts, with the rows of a whole search."""
    import tracemalloc

    draw = random.Random(5)
    words = set()
    while len(words) < 3 * P.BLOCK:
        words.add("".join(draw.choices("abcd", k=draw.randrange(9, 11))))
    rows = [(w, draw.randrange(5, 99), 2 * (i // 2), 2 * (i // 2)) for i, w in enumerate(sorted(words))]
    tracemalloc.start()
    try:
        got = P._block_rows(9, 0, rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60e6
    want = set()
    for (one, *_), (two, *_) in zip(rows[::2], rows[1::2]):
        # two words of m + 1 letters meet in the block of m + 1
        if near(one, two) and not len(one) == len(two) == 10:
            want |= {one, two}
    assert sorted(got.column("word").to_pylist()) == sorted(want) and len(want) > 50


def test_variants_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in P.spelling_variants(docs).collect()}
    assert got == brute_variants(rows, P.MIN_LETTERS, P.MIN_COUNT, P.SLIP)


def test_variants_odd_rows(odd_docs, no_docs, make_docs):
    assert {r.word for r in P.spelling_variants(odd_docs).collect()} == set()
    long = "ab" * 40_000
    got = P.spelling_variants(make_docs([(1, f"{long} {long}x " * 5)] * 6)).collect()
    assert {(len(r.word), r.n, r.n_near, r.form) for r in got} == {(80_000, 30, 1, None), (80_001, 30, 1, None)}
    assert P.spelling_variants(no_docs).count() == 0
