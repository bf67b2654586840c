"""Secret scan by assignment-aware lexing.

Three base kinds are plain patterns (assign, access, hex).  On top of them every
text is lexed as source code or configuration: comments, string literals, numbers,
names, operators.  Statements ``name = value``, ``name: value``, ``"name": value``,
``name => value`` become name-literal pairs; a value may be a literal, a name bound
before (constants are propagated), or a ``+`` concatenation of those.  A literal is
scored by the words of its target name and reported as kind ``lexed`` from
``MIN_SCORE`` on, at each place where a part of it is written.  Literals that hold spaces
count under the surest names only (password, passwd, passphrase), and not as sentences.

Scale: row-local, no shuffle; one Arrow function over the text column.  Lexing and
propagation are linear in the text: constants refer to their parts instead of copying
them (so ``a = a + a`` over many lines stays small), and what is never closed is looked
for once.

Defined cases: a null text is empty; offsets are code points, end exclusive;
matches that are too short are dropped after matching (they still use up their
text); empty texts and texts without a match give zero counts and empty strings;
repeated rows give repeated results; very long texts are lexed whole; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
ASSIGN = re.compile(r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs; shorter runs would be dropped anyway
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "lexed")

# Weights of the words of a target name.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7,
    "secret": 0.9, "token": 0.8, "credential": 0.8, "credentials": 0.8, "apikey": 0.9,
    "private": 0.4, "key": 0.4, "api": 0.3, "access": 0.3, "auth": 0.4, "bearer": 0.6,
    "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.2, "salt": 0.4,
    "connection": 0.2, "dsn": 0.4,
}
MIN_SCORE = 0.8
MIN_LITERAL = 6
_HEAVY = re.compile("(?i:" + "|".join(sorted(k for k, v in NAME_WEIGHTS.items() if v >= 0.4)) + ")")
_LIGHT = re.compile("(?i:" + "|".join(sorted(k for k, v in NAME_WEIGHTS.items() if v < 0.4)) + ")")
#: Words whose names may hold literals of several words.
PHRASE_WORDS = {w for w, v in NAME_WEIGHTS.items() if v == 1.0}

_TOKEN = re.compile(r"""
    (?P<open>/\*|<!--)
  | (?P<quote>["'`])
  | (?P<ref>\$\{[A-Za-z_]\w*\}|\$[A-Za-z_]\w*)
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*(?:[.-][A-Za-z_][A-Za-z0-9_]*)*)
  | (?P<bind>:=|=>|=(?!=)|:(?![:/]))
  | (?P<plus>\+)
  | (?P<end>[;,\n{}()\[\]])
  | (?P<bare>[A-Za-z0-9_+/.~!@%^&*?|-]+=*)
""", re.X | re.S)
_BARE = re.compile("[A-Za-z0-9_+/.~!@%^&*?|-]+=*")
_CLOSE = {"/*": "*/", "<!--": "-->"}
#: What a string holds up to its closing quote or an end of line.
_BODY = {'"': re.compile(r'(?:[^"\\\n]|\\.)*', re.S), "'": re.compile(r"(?:[^'\\\n]|\\.)*", re.S),
         "`": re.compile(r"[^`\n]*")}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i:^(?:x+|\*+|\.+|<.*>|changeme|example|placeholder|none|null|true|false|undefined|your[_-].*)$)")


def name_score(name: str) -> float:
    """0 to 1: how surely a variable of this name holds a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    total = sum(NAME_WEIGHTS.get(w, 0.0) for w in words)
    for a, b in zip(words, words[1:]):
        if (a, b) in (("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key")):
            total += 0.4
    return min(1.0, total)


def may_name_secrets(text: str) -> bool:
    """False only where no name in the text can reach ``MIN_SCORE``: that takes a word of
    weight 0.4 or more, or three lighter ones."""
    if _HEAVY.search(text):
        return True
    light = _LIGHT.finditer(text)
    return all(next(light, None) for _ in range(3))


def _lex(text: str):
    """(kind, value, start, end) without comments, in time linear in the text: a comment
    that is never closed, or a string that its line doesn't close, is looked for once."""
    pos, n = 0, len(text)
    closed = dict.fromkeys(_CLOSE, True)
    open_until = dict.fromkeys(_BODY, 0)
    while m := _TOKEN.search(text, pos):
        kind, value, start, end = m.lastgroup, m.group(), m.start(), m.end()
        if kind == "open":
            at = text.find(_CLOSE[value], end) if closed[value] else -1
            if at >= 0:
                pos = at + len(_CLOSE[value])
                continue
            closed[value] = False
            m = _BARE.match(text, start)
            if not m:
                pos = start + 1
                continue
            kind, value, end = "bare", m.group(), m.end()
        elif kind == "quote":
            pos = end
            if start < open_until[value]:
                continue
            last = _BODY[value].match(text, end).end()
            if last >= n or text[last] != value:
                # quotes up to here are escaped, and so are they for a string begun at one
                open_until[value] = last
                continue
            kind, value, start, end, pos = "string", text[end:last], end, last, last + 1
            yield kind, value, start, end
            continue
        elif kind == "ref":
            value = value.strip("${}")
        pos = end
        yield kind, value, start, end


class Literal:
    """A literal as it is written, or a concatenation of literals.

    A concatenation refers to its parts, which are never copied; its length and the shares
    of its characters come from theirs, its text as long as it is short."""

    __slots__ = ("parts", "start", "end", "text", "size", "shares", "spaced")
    SHORT = 4096

    def __init__(self, parts=(), text: str | None = None, start: int = 0, end: int = 0):
        self.parts, self.start, self.end = parts, start, end
        if not parts:
            self.text, self.size, self.spaced = text, float(len(text)), " " in text
            self.shares = {c: k / len(text) for c, k in Counter(text).items()}
            return
        self.size = min(sum(p.size for p in parts), 1e300)
        self.text = "".join(p.text for p in parts) if self.size <= self.SHORT else None
        self.spaced = any(p.spaced for p in parts)
        self.shares = {}
        whole = sum(p.size / self.size for p in parts) if self.size else 1.0
        for p in parts:
            weight = p.size / self.size / whole if self.size else 0.0
            for c, share in p.shares.items():
                self.shares[c] = self.shares.get(c, 0.0) + weight * share

    def entropy(self) -> float:
        """Shannon entropy in bits a character."""
        return -sum(x * math.log2(x) for x in self.shares.values() if x > 0)


def assignments(text: str) -> list[tuple[str, Literal]]:
    """(target name, literal) of every name-literal pair, constants and concatenations
    resolved.  A name on the right is the constant that it was before."""
    constants: dict[str, Literal] = {}
    out = []
    tokens = list(_lex(text))
    i, n = 0, len(tokens)
    while i < n:
        kind, value, _, _ = tokens[i]
        if not (kind in ("name", "string") and i + 1 < n and tokens[i + 1][0] == "bind"):
            i += 1
            continue
        target, i = value, i + 2
        pieces: list[Literal] = []
        while i < n:
            k, v, s, e = tokens[i]
            if k in ("string", "bare"):
                pieces.append(Literal(text=v, start=s, end=e))
            elif k in ("name", "ref"):
                known = constants.get(v)
                if known is None and k == "name":  # an unquoted value of a configuration file
                    nxt = tokens[i + 1] if i + 1 < n else None
                    if nxt and nxt[0] == "bare" and nxt[2] == e:
                        v, e, i = v + nxt[1], nxt[3], i + 1
                    if any(c.isdigit() for c in v):
                        known = Literal(text=v, start=s, end=e)
                if known is not None:
                    pieces.append(known)
            else:
                break
            i += 1
            if i < n and tokens[i][0] == "plus":
                i += 1
            else:
                break
        if pieces:
            constants[target] = pieces[0] if len(pieces) == 1 else Literal(tuple(pieces))
            out.append((target, constants[target]))
    return out


def literal_score(target: str, literal: Literal) -> float:
    """How surely a literal of a target name is a secret; 0 where it is none."""
    if literal.size < MIN_LITERAL or (literal.text is not None and _PLACEHOLDER.match(literal.text)):
        return 0.0
    score = name_score(target)
    if score < MIN_SCORE:
        return 0.0
    # words with spaces are a secret only under the surest names, and no sentence
    if literal.spaced and (PHRASE_WORDS.isdisjoint(w.lower() for w in _WORD.findall(target))
                           or literal.text is None or literal.text.rstrip()[-1:] in ".:?!"):
        return 0.0
    score = min(1.0, score * (0.6 + 0.4 * min(1.0, literal.entropy() / 3.0)))
    return score if score >= MIN_SCORE * 0.6 else 0.0


def lexed_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals assigned to sensitive names, each as it is written,
    with the highest score of the names that it reaches."""
    if not may_name_secrets(text):
        return []
    scored = [(v, x) for t, x in assignments(text) if (v := literal_score(t, x))]
    scored.sort(key=lambda y: -y[0])
    best: dict[tuple[int, int], float] = {}
    seen: set[int] = set()
    for score, literal in scored:      # the first to reach a part is the highest
        stack = [literal]
        while stack:
            x = stack.pop()
            if id(x) in seen:
                continue
            seen.add(id(x))
            stack.extend(x.parts)
            if not x.parts and x.end > x.start:
                best[x.start, x.end] = max(score, best.get((x.start, x.end), 0.0))
    return [(s, e, v) for (s, e), v in sorted(best.items())]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
             if len(m.group(2)) >= MIN_ASSIGN]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= MIN_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCAN_SCHEMA = ("n_assign long, n_access long, n_hex long, n_lexed long, base_sha256 string, "
               "spans string, max_score double")


def _scan_batch(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        t = t or ""
        base = base_spans(t)
        lexed = lexed_spans(t)
        n = Counter(k for k, _, _ in base)
        every = sorted(base + [("lexed", s, e) for s, e, _ in lexed],
                       key=lambda x: (x[1], KINDS.index(x[0])))
        rows.append((n["assign"], n["access"], n["hex"], len(lexed),
                     hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(every),
                     1.0 if base else max((v for _, _, v in lexed), default=0.0)))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_lexed",
                                       "base_sha256", "spans", "max_score"])


def scan(text: Column) -> Column:
    """Struct of counts, digest, spans and the highest score of one text."""
    return F.pandas_udf(_scan_batch, SCAN_SCHEMA)(text)


def scan_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_lexed, base_sha256, spans, max_score)."""
    return df.select(F.col(key), scan(F.col(text)).alias("found")).select(key, "found.*")


def secret_values(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per span with the text it covers: (key, kind, start, end, value)."""
    spans = df.select(F.col(key), F.col(text), scan(F.col(text))["spans"].alias("spans"))
    one = (spans.where(F.col("spans") != "")
                .select(key, text, F.explode(F.split("spans", ",")).alias("span"))
                .select(key, text, F.split("span", ":").alias("p")))
    start, end = F.col("p")[1].cast("int"), F.col("p")[2].cast("int")
    return one.select(key, F.col("p")[0].alias("kind"), start.cast("long").alias("start"),
                      end.cast("long").alias("end"),
                      F.substring(F.col(text), start + 1, end - start).alias("value"))


def redact(df: DataFrame, text: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """The table with every span of the text replaced by ``mask``."""
    @F.pandas_udf("string")
    def cover(values: pd.Series) -> pd.Series:
        out = []
        for t in values:
            if t is None:
                out.append(None)
                continue
            pieces, at = [], 0
            spans = sorted([(s, e) for _, s, e in base_spans(t)]
                           + [(s, e) for s, e, _ in lexed_spans(t)])
            for s, e in spans:
                if e <= at:
                    continue
                if s >= at:
                    pieces += [t[at:s], mask]
                at = e
            out.append("".join(pieces) + t[at:])
        return pd.Series(out)
    return df.withColumn(text, cover(F.col(text)))
