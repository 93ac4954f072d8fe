"""Scores for abusive, hateful and sexual content (problem 8).

The words of a text are undisguised (case, accents, width, invisible letters, look-alike
letters, digits and signs for letters, letters set apart, stretched letters) and looked up
in a trie of the lexicon by a Levenshtein automaton: one letter off for words of six
letters or more, two from ten, any letter for a masking star. The hits of a text are matched against
phrase rules within windows of a few words, so that a rough word about software or a plain
mention carries no weight, and words of mention near a match take weight off it. Terms
of the reviewers' list that stand alone give a low score only.

Defined cases: null and blank texts have no rows; a repeated document is scored like any other;
texts of any length are read whole; other languages than en, pt, es, fr and de match only by chance;
an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.folding import fold
from quillspark.llm import abuse_lexicon as lex
from quillspark.operators.spread import spread_out

CATEGORIES = ("abusive", "hateful", "sexual")
THRESHOLD = 0.5
LONE = 0.15
MOST = 24  # letters of a token, drawn-out ones counted once

# fixed values: Cyrillic and Greek letters that look like Latin ones
_LOOKS = str.maketrans("аеорсухіјѕԁһвкмнтгпиαορνικετυχβ", "aeopcyxijsdhbkmhtrniaopvikeTuxb".lower())
_DIGITS = str.maketrans("0134578$@!|", "oieastbsail")
_DIGITS_L = str.maketrans("0134578$@!|", "oleastbsall")
_TOKEN = re.compile(r"[$@]?[^\W_](?:[\w$@*!|]*[\w$@*])?|[*][\w*]*\w", re.U)
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-·_*]))(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_STOP = re.compile(r"[.!?…。\n;|\"](?:\s|$|[\"'|])|\n")
_RUN3 = re.compile(r"(.)\1\1+")
_RUN2 = re.compile(r"(.)\1+")
_LATIN = re.compile(r"[a-z]")
_OTHER = re.compile(r"[Ͱ-ӿԀ-ԯ]")
_HASDIGIT = re.compile(r"[\d$@!|]")


class Trie:
    """The lexicon with a Levenshtein automaton run along it."""

    def __init__(self, words: set[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, token: str, most: int, wild: bool = False) -> list[tuple[str, int]]:
        """(word, distance) for all words at most ``most`` edits away; a star in ``token`` stands for any letter."""
        out: list[tuple[str, int]] = []
        n = len(token)
        stack = [(self.root, tuple(range(n + 1)), "", None)]
        while stack:
            node, row, last, before = stack.pop()
            w = node.get("")
            if w is not None and row[n] <= most:
                out.append((w, row[n]))
            for c, nxt in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    t = token[i - 1]
                    cost = 0 if t == c or (wild and t == "*") else 1
                    d = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + cost)
                    if most == 1 and before is not None and i > 1 and t == last and token[i - 2] == c:
                        d = min(d, before[i - 2] + 1)
                    new.append(d)
                if min(new) <= most:
                    stack.append((nxt, tuple(new), c, row))
        return out


class Parts:
    """Tells tokens that can be near no word, before the automaton runs.

    One edit leaves the first or the second half of a word as it is, a swap across the middle all but
    the two letters there; two edits leave a third of it as it is, at most two places off.
    """

    def __init__(self, words: set[str]):
        self.halves: set[tuple[int, str]] = set()
        self.rests: set[tuple[int, str]] = set()
        self.thirds: set[tuple[int, int, str]] = set()
        for w in words:
            m, h = len(w), len(w) // 2
            self.halves |= {(m, w[:h]), (-m, w[h:])}
            self.rests.add((m, w[: h - 1] + w[h + 1 :]))
            cut = (0, m // 3, 2 * m // 3, m)
            self.thirds |= {(m, k, w[cut[k] : cut[k + 1]]) for k in range(3)}

    def one(self, t: str) -> bool:
        n = len(t)
        h = n // 2
        if (n, t[: h - 1] + t[h + 1 :]) in self.rests:
            return True
        return any((m, t[: m // 2]) in self.halves or (-m, t[n - (m - m // 2) :]) in self.halves for m in (n - 1, n, n + 1))

    def two(self, t: str) -> bool:
        n = len(t)
        for m in range(n - 2, n + 3):
            a, b = m // 3, 2 * m // 3
            if (m, 0, t[:a]) in self.thirds or (m, 2, t[n - (m - b) :]) in self.thirds or any((m, 1, t[k : k + b - a]) in self.thirds for k in range(a - 2, a + 3)):
                return True
        return False


class Scorer:
    """The compiled lexicon and rules. ``terms``: (term, category) pairs of the reviewers' list."""

    def __init__(self, terms: list[tuple[str, str]]):
        classes = {k: set(v.split()) for k, v in lex.CLASSES.items()}
        self.lone: dict[str, set[str]] = {}
        for term, category in terms:
            t = fold(term)
            self.lone.setdefault(t, set()).add(category)
        self.rules: list[tuple[str, list[tuple[frozenset[str], int]]]] = []
        for category, text in (("abusive", lex.ABUSIVE), ("hateful", lex.HATEFUL), ("sexual", lex.SEXUAL)):
            for line in text.strip().splitlines():
                seq, gap = [], 0
                for part in line.split():
                    if part[0] == "~":
                        gap = int(part[1:])
                        continue
                    words: set[str] = set()
                    for alt in part.split("|"):
                        words |= classes[alt] if alt in classes else {alt}
                    seq.append((frozenset(words), gap if seq else 0))
                    gap = 0
                self.rules.append((category, seq))
        words = {w for _, seq in self.rules for ws, _ in seq for w in ws} | set(self.lone) | lex.MENTION
        self.words = frozenset(words)
        self.fuzzy = Trie({w for w in words if len(w) >= 6})
        self.parts = Parts({w for w in words if len(w) >= 6})
        self.trie = Trie(words)
        self.short: dict[str, str] = {}
        for w in sorted(words, key=len):
            s = _RUN2.sub(r"\1", w)
            if len(s) >= 3:
                self.short.setdefault(s, w)
        self.starts: dict[str, list[int]] = {}
        for k, (_, seq) in enumerate(self.rules):
            for w in seq[0][0]:
                self.starts.setdefault(w, []).append(k)
        self.memo: dict[str, tuple[tuple[str, ...], float] | None] = {}

    def lookup(self, token: str, apart: bool = False) -> tuple[tuple[str, ...], float] | None:
        """(lexicon words a token may stand for, weight), or nothing."""
        if token in self.words:
            return (token,), 1.0
        found: set[str] = set()
        weight = 1.0
        t = token
        if _OTHER.search(t):
            if not _LATIN.search(t) and not _HASDIGIT.search(t):
                return None
            t = t.translate(_LOOKS)
            if t in self.words:
                return (t,), 1.0
        if not _LATIN.search(t):
            return None
        if len(t) > MOST and min(len(_RUN2.sub(r"\1", t.translate(table))) for table in ({}, _DIGITS, _DIGITS_L)) > MOST:
            return None  # too long however far it is drawn out
        if "*" in t:
            if len(t) > MOST:
                t = _RUN3.sub(r"\1", t)
            if len(t.replace("*", "")) >= 2:
                found = {w for w, d in self.trie.within(t, 0, True)}
                if not found and len(t) >= 4:
                    found = {w for w, d in self.trie.within(t.replace("*", ""), 0)}
        elif _HASDIGIT.search(t):
            for table in (_DIGITS, _DIGITS_L):
                u = t.translate(table)
                found |= {x for x in (u, self.short.get(_RUN2.sub(r"\1", u)) if _RUN3.search(u) else None) if x in self.words}
        elif _RUN3.search(t):
            s = self.short.get(_RUN2.sub(r"\1", t))
            if s:
                found = {s}
            else:
                u = _RUN3.sub(r"\1", t)
                if 6 <= len(u) <= MOST:
                    found = {w for w, _ in self.fuzzy.within(u, 1)}
        elif apart:
            for u in (t, t[1:], t[:-1]):
                if u in self.words:
                    found.add(u)
        if not found and t.isalpha() and len(t) >= 5 and (self.parts.two(t) if len(t) >= 10 else self.parts.one(t)):
            near = self.fuzzy.within(t, 2 if len(t) >= 10 else 1)
            if near:
                best = min(d for _, d in near)
                found = {w for w, d in near if d == best}
                weight = 1.0 - 0.15 * best
        return (tuple(sorted(found)), weight) if found else None

    def hits(self, text: str) -> list[tuple[int, tuple[str, ...], float, int]]:
        """(word position, lexicon words, weight, sentence) along the text."""
        t = unicodedata.normalize("NFKC", text)
        t = fold(t)
        joined: set[str] = set()

        def join(m: re.Match) -> str:
            u = m[0].replace(m[1], "")
            joined.add(u)
            return u

        if _APART.search(t):
            t = _APART.sub(join, t)
        out = []
        memo = self.memo
        said, end = 0, 0
        for k, m in enumerate(_TOKEN.finditer(t)):
            w = m[0]
            said += _STOP.search(t, end, m.start()) is not None
            end = m.end()
            if w in memo:
                r = memo[w]
            else:
                r = self.lookup(w, w in joined)
                if len(memo) > 400_000:
                    memo.clear()
                memo[w] = r
            if r is not None:
                out.append((k, r[0], r[1], said))
        return out

    def _follow(self, hits, at: int, seq, k: int, weight: float) -> tuple[int, float] | None:
        if k == len(seq):
            return at, weight
        words, gap = seq[k]
        pos = hits[at][0]
        j = at + 1
        while j < len(hits) and hits[j][0] - pos <= gap + 1:
            if any(w in words for w in hits[j][1]):
                r = self._follow(hits, j, seq, k + 1, weight * hits[j][2])
                if r:
                    return r
            j += 1
        return None

    def matches(self, text: str) -> list[tuple[str, float]]:
        hits = self.hits(text)
        out: list[tuple[str, float]] = []
        for i, (pos, words, weight, said) in enumerate(hits):
            for w in words:
                for k in self.starts.get(w, ()):
                    category, seq = self.rules[k]
                    r = self._follow(hits, i, seq, 1, weight)
                    if r:
                        # a word of mention shortly before, in the same sentence, speaks of such language
                        j, mention = i - 1, False
                        while j >= 0 and hits[j][0] >= pos - 5 and hits[j][3] == said:
                            mention = mention or any(x in lex.MENTION for x in hits[j][1])
                            j -= 1
                        out.append((category, max(0.0, r[1] - 0.6 * mention)))
                for c in self.lone.get(w, ()):
                    out.append((c, LONE * weight))
        return out

    def score(self, text: str | None) -> dict[str, tuple[float, int]]:
        """category -> (score, matches): 1 minus the product of what each match leaves open; lone terms never reach the threshold."""
        if not text or not text.strip():
            return {}
        strong: dict[str, float] = {}
        weak: dict[str, float] = {}
        n: dict[str, int] = {}
        for c, s in self.matches(text):
            n[c] = n.get(c, 0) + 1
            if s > LONE:
                strong[c] = 1 - (1 - strong.get(c, 0.0)) * (1 - 0.9 * s)
            else:
                weak[c] = max(weak.get(c, 0.0), s)
        return {c: (round(max(strong.get(c, 0.0), weak.get(c, 0.0)), 4), n[c]) for c in n}


_SCORERS: dict[tuple, Scorer] = {}


def content_scores(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, category, score, n_matches) for every document and category with any match."""
    spark = docs.sparkSession
    listed = sorted({(r[0], r[1]) for r in terms.where("term is not null and category is not null").select("term", "category").collect()})  # a fixed list of reviewers
    held = spark.sparkContext.broadcast(listed)

    def run(batches):
        key = tuple(held.value)
        s = _SCORERS.get(key)
        if s is None:
            s = _SCORERS[key] = Scorer(held.value)
        for pdf in batches:
            rows = [(i, c, v, n) for i, t in zip(pdf["id"], pdf["t"]) for c, (v, n) in s.score(t).items()]
            yield pd.DataFrame({"id": pd.Series([r[0] for r in rows], dtype="int64"), "category": pd.Series([r[1] for r in rows], dtype="object"), "score": pd.Series([r[2] for r in rows], dtype="float64"), "n_matches": pd.Series([r[3] for r in rows], dtype="int32")})

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    return spread_out(src).mapInPandas(run, "id long, category string, score double, n_matches int")


def source_rates(docs: DataFrame, scores: DataFrame, id_col: str, source_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, and for each category the share of documents at or over the threshold."""
    name = F.when(F.trim(F.col(source_col)) != "", F.col(source_col)).otherwise(F.lit("unknown"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), name.alias("source"))
    flags = scores.where(F.col("score") >= threshold).groupBy("id").agg(*[F.max((F.col("category") == c).cast("int")).alias(c) for c in CATEGORIES])
    x = base.join(flags, "id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"n_{c}") for c in CATEGORIES])
    return x.select("source", "n_docs", *[f"n_{c}" for c in CATEGORIES], *[F.round(F.col(f"n_{c}") / F.col("n_docs"), 6).alias(f"{c}_rate") for c in CATEGORIES])
