"""Domain lexicon (E9) and the small gazetteer used for typed entities."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import all_ngrams, col_

# The 56-term lexicon in its six categories, as written in the
# reference (matching lower-cases them).
LEXICON = {
    "numbers": ["crore", "lakh", "thousand", "lakhs", "crores"],
    "titles": ["PM", "CM", "IAS", "IPS", "IFS", "Lok Sabha", "Rajya Sabha",
               "Chief Minister", "Prime Minister", "MLA", "MP", "Minister"],
    "political": ["BJP", "Congress", "AAP", "NDA", "UPA", "CPI", "TMC",
                  "DMK", "AIADMK", "Shiv Sena", "JDU", "RJD"],
    "admin": ["Panchayat", "Municipality", "District Collector",
              "Tehsildar", "Gram Sabha", "Zila Parishad"],
    "cultural": ["dharma", "karma", "puja", "darshan", "prasad",
                 "Diwali", "Holi", "Eid", "Ganesh Chaturthi", "Navratri"],
    "institutions": ["ISRO", "DRDO", "AIIMS", "IIT", "IIM", "RBI",
                     "SEBI", "CBI", "ED", "IT Department", "CAG"],
}
LEXICON_ROWS = [(cat, t.lower()) for cat, terms in LEXICON.items() for t in terms]
LEXICON_TERMS = list(dict.fromkeys(t for _, t in LEXICON_ROWS))
MAX_TERM_WORDS = max(len(t.split()) for t in LEXICON_TERMS)

# A small gazetteer over frequent words of the driver text (stand-in for a trained NER model; any table with
# the same (ent_type, term) schema can be passed instead).
GAZETTEER = [("PERSON", "chief minister"), ("GPE", "the"), ("ORG", "of the"),
             ("ORG", "rs"), ("GPE", "le"), ("PERSON", "der")]
ENTITY_TOKEN = "[A-Za-z0-9]+"


def terms_substring(lower_text) -> Column:
    """Lexicon terms occurring as substrings of the (already lower-cased) text.

    Reference semantics: ``ed`` hits "allocated", ``pm`` hits "development".
    """
    t = col_(lower_text)
    arr = F.array(*[F.lit(x) for x in LEXICON_TERMS])
    # ``t`` is referenced outside the lambda too: a column read only inside a
    # lambda would be inlined there by the optimizer and recomputed per term.
    return F.when(t.isNull(), F.array().cast("array<string>")) \
            .otherwise(F.filter(arr, lambda term: t.contains(term)))


#: Terms up to which a text is scanned once a term; beyond, once by an automaton.
SCAN_TERMS = 64
#: UTF-8 bytes of a lexicon that may travel to every worker.
LEXICON_BYTES = 64 << 20

_AUTOMATA: dict[str, tuple] = {}


def build_automaton(terms: list[str]):
    """Aho-Corasick automaton of the terms; a term's value is its place in the list."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, i)
    if terms:
        out.make_automaton()
    return out


def find_terms(automaton, terms: list[str], text: str) -> list[str]:
    """The terms that stand in a text, in lexicon order, by one pass over the text;
    terms inside or across each other are all found."""
    if not terms:
        return []
    return [terms[i] for i in sorted({i for _, i in automaton.iter(text)})]


def lexicon_terms(lexicon) -> list[str]:
    """Distinct lower-case terms, in order, of a list or of the ``term`` column of a table
    (sorted), whose size is checked before it is collected."""
    if isinstance(lexicon, DataFrame):
        terms = lexicon.select(F.lower("term").alias("term")).where("term is not null").distinct()
        size = terms.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
        if size > LEXICON_BYTES:
            raise ValueError(f"a lexicon of {size} bytes is over the {LEXICON_BYTES} that each worker may hold")
        return sorted(r["term"] for r in terms.collect() if r["term"])
    return [t for t in dict.fromkeys(t.lower() for t in lexicon) if t]


def terms_automaton(spark: SparkSession, lower_text, terms: list[str]) -> Column:
    """Terms of a lexicon of any length (see ``lexicon_terms``) in the lower-cased text; the
    terms are broadcast and the automaton is built once a worker."""
    name = hashlib.md5("\0".join(terms).encode()).hexdigest()
    held = spark.sparkContext.broadcast(terms)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()                  # a worker keeps the latest lexicon only
            _AUTOMATA[name] = (build_automaton(held.value), held.value)
        automaton, known = _AUTOMATA[name]
        return pd.Series([[] if t is None else find_terms(automaton, known, t) for t in texts])

    return found(col_(lower_text))


def terms_word(tokens: str) -> Column:
    """Lexicon terms occurring as whole words / word sequences.

    ``tokens`` names a materialised ROUGE-token column (it is read inside the
    n-gram lambda, so it must not be an unevaluated expression).
    """
    grams = all_ngrams(tokens, MAX_TERM_WORDS)
    arr = F.array(*[F.lit(x) for x in LEXICON_TERMS])
    return F.array_intersect(arr, grams)
