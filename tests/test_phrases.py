"""The mined gazetteer against a plain-Python miner."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from summarium.operators import factuality as FX
from summarium.operators import phrases as PH


def brute_mine(texts, max_words=3, min_count=5, significance=3.0):
    n, seen, votes, total = Counter(), Counter(), Counter(), 0
    for text in texts:
        w = re.findall("[A-Za-z0-9]+", text or "")
        total += len(w)
        for i in range(len(w)):
            seen[w[i].lower()] += 1
            before = w[i - 1].lower() if i else None
            for k in range(1, max_words + 1):
                run = w[i:i + k]
                if len(run) == k and all(x[0].isupper() for x in run):
                    g = " ".join(run).lower()
                    n[g] += 1
                    for kind, cues in PH.CUES_BEFORE.items():
                        votes[g, kind] += before in cues
    units = {g: None for g, c in n.items() if " " not in g and c >= min_count and 2 * c >= seen[g]}
    held = Counter()
    for k in range(2, max_words + 1):
        new = {}
        for g, c in n.items():
            words = g.split(" ")
            if len(words) != k or c < min_count:
                continue
            found = []
            for j in range(1, k):
                a, b = " ".join(words[:j]), " ".join(words[j:])
                if a in units and b in units:
                    found.append(((c - n[a] * n[b] / total) / math.sqrt(c), -j, {a, b}))
            if found and max(found[:], key=lambda x: x[:2])[0] >= significance:
                best = max(found, key=lambda x: x[:2])
                new[g] = best[0]
                for part in best[2]:
                    held[part] += c
        units |= new
    out = set()
    for g, s in units.items():
        if n[g] - held[g] < min_count:
            continue
        ballot = {k: votes[g, k] + n[g] * bool(set(g.split(" ")) & set(PH.CUES_INSIDE[k])) for k in PH.CUES_BEFORE}
        kind = max(ballot, key=lambda k: ballot[k])
        out.add((kind if ballot[kind] else PH.NO_TYPE, g, len(g.split(" ")), n[g], s and round(s, 6)))
    return out


def news(n=300, seed=5):
    draw = random.Random(seed)
    names = ["Asha Rao", "Chief Minister Nair", "Bank of Goa", "Goa", "New Delhi", "Tata Steel Ltd", "Rao", "X1 Y2 Z3"]
    fill = "the a budget rose fell and then in by of for mr from said talks were held".split()
    out = []
    for _ in range(n):
        parts = [draw.choice(names) if draw.random() < 0.2 else draw.choice(fill) for _ in range(draw.randrange(40))]
        text = " ".join(parts)
        out.append(text[:1].upper() + text[1:] + draw.choice([".", "", "!"]))
    return out + [None, "", " .. ", "Goa"]


def test_mined_phrases_equal_brute_force(spark):
    texts = news()
    df = spark.createDataFrame([(t, "clash", 1) for t in texts], "body string, term string, n long").repartition(3)
    got = {tuple(r) for r in PH.mine_phrases(df, "body").withColumn("significance", F.round("significance", 6)).collect()}
    want = brute_mine(texts)
    assert got == want
    terms = {r[1]: r[0] for r in got}
    assert terms["asha rao"] and terms["tata steel ltd"] == "ORG" and terms["chief minister nair"] == "PERSON"
    assert "asha" not in terms and "rao" in terms and "the" not in terms


def test_mining_nothing(spark):
    empty = spark.createDataFrame([], "body string")
    assert PH.mine_phrases(empty, "body").count() == 0
    assert PH.mine_phrases(spark.createDataFrame([(None,), ("",)], "body string"), "body").count() == 0


def test_mined_gazetteer_finds_mentions(spark):
    df = spark.createDataFrame([(t,) for t in news()], "body string")
    mined = PH.mine_phrases(df, "body")
    one = spark.createDataFrame([("Talks with Asha Rao of Tata Steel Ltd",)], "body string")
    found = FX.with_entities(one, "body", "e", mined).first().e
    assert {x.ent_text for x in found} >= {"Asha Rao", "Tata Steel Ltd"}
