"""The corpus pipeline: contract of its stages, decisions, odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import regex
from pyspark.sql import functions as F

from summarium.llm import ngram_join, poisson_mix, spaced_seeds, virtual_slots
from summarium.llm.common import staged
from summarium.llm.ngram_join import linked_documents

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("old"))
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        sizes.append(out.count())
        if i < 4:
            assert out.columns == docs.columns, name
        docs = out
    assert len(corpus_pipeline.STAGES) == 5
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] == sizes[5] > 0
    assert docs.select("shard").distinct().count() == 8
    unique = docs.dropDuplicates(["doc_id"])
    assert linked_documents(unique).where("n_links > 0").count() == 0
    assert spaced_seeds.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    junk = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
    assert docs.join(junk, "doc_id", "left_semi").select("doc_id").distinct().count() <= 3


def test_clean_documents_stay(spark):
    """No labelled good document is lost by the quality stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    kept = dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, SF)
    assert good.join(docs, "doc_id", "left_semi").join(kept, "doc_id", "left_anti").count() == 0


def test_odd_rows_and_empty_table(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.count()


def test_run_is_registered():
    import __spark_entry__ as E
    q = E.queries()
    assert q["pipeline"] is corpus_pipeline.run
    assert all(any(n.startswith(f"op{i}_") for n in q) for i in range(1, 11))


def one_of_each(texts):
    """Ids that stay: the smallest of each component of exact Jaccard links."""
    sets = {}
    for k, text in texts.items():
        w, n = (text or "").encode().lower().split(), ngram_join.SHINGLE
        sets[k] = {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= ngram_join.PERCENT * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in ids if find(k) == k}


def holds(doc, item):
    """Whether some diagonal has a window of the item that is equal enough."""
    n, width = len(item), min(len(item), spaced_seeds.WINDOW)
    need = width if n < spaced_seeds.WHOLE else math.ceil(spaced_seeds.MATCH * width)
    padded = np.concatenate([np.full(n, -1), doc, np.full(n, -1)])
    at = np.arange(len(doc) + n)[:, None] + np.arange(n)[None, :]
    sums = np.cumsum(np.pad(padded[at] == item, ((0, 0), (1, 0))), axis=1)
    return n >= spaced_seeds.LEAST and bool((sums[:, width:] - sums[:, :-width] >= need).any())


def test_run_equals_plain_python(spark, monkeypatch):
    """Every stage after the classifier (whose fit has tests of its own), on all its rows."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = staged(corpus_pipeline.keep_quality(spark, docs, sf), "kept")
    stages = [("quality_classifier", lambda *_: kept), *corpus_pipeline.STAGES[1:]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = corpus_pipeline.run(spark, sf).collect()

    rows = kept.collect()
    texts = {r.doc_id: r.text for r in rows}
    source = {r.doc_id: r.source for r in rows}
    assert len(texts) == len(rows)
    first = one_of_each(texts)
    assert len(first) < len(texts)

    number = defaultdict(lambda: len(number))
    words = lambda t: np.array([number[w] for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w], int)
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {k for k in first if not any(holds(words(texts[k]), i) for i in items)}
    assert len(clean) < len(first)

    size = Counter()
    for k in clean:
        size[source[k]] += len((texts[k] or "").encode()) + 1
    weight = {s: n ** poisson_mix.ALPHA for s, n in size.items()}
    scale = sum(size.values()) / sum(weight.values())
    want = Counter()
    for k in clean:
        rate = scale * weight[source[k]] / size[source[k]]
        u = int(hashlib.md5(f"{poisson_mix.SEED}:{k}".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-rate)
        c = p
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        if n:
            want[k] = n
    assert Counter(r.doc_id for r in got) == want

    load = Counter()
    for r in got:
        load[r.virtual_slot] += len((r.text or "").encode()) + 1
    shards = virtual_slots.edit_map(virtual_slots.initial_map(8), load, 8)
    assert all(r.shard == shards[r.virtual_slot] for r in got)
