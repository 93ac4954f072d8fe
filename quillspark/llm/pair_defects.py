"""Broken prompt and response pairs (problem 4).

The last fragments of all responses and the sentences of all sources are sorted together by text. A
fragment that is a prefix of its neighbour, without being equal, is a shortened version of
something in the corpus: only such fragments can be cut off, and they are, if the sentence they
shorten is one of their own source. ``shortened_responses`` applies the same sort to whole responses.
``length_spikes`` finds lengths at which far more responses end, unfinished, than at the
lengths around; an unfinished response of such a length that stops inside its source is also taken as cut off.
Rules for empty, refusing, copying and wrong-language responses go first, in that order.

A response is in another language than its source if function words say so, or if its letters
are far less likely under the letter model of the source's language than that language's own texts are (``LETTER_GAP``)
and hardly any of its words are function words of that language. Letter models are trigram
counts over all sources, added up by the executors; the driver and the executors hold one number per language and trigram.

Defined cases: pairs without a source are not judged; a null, blank or stand-in target is
``empty``; of several defects the first of the order holds; repeated rows are judged alike;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.functions.folding import fold
from quillspark.llm.language_cues import FUNCTION_WORDS, REFUSALS, guess_language, prose_words
from quillspark.operators.spread import spread_out
from quillspark.session import materialize

DEFECTS = ("empty", "refusal", "copied", "wrong_language", "truncated")

# fixed values: stand-ins for content, folded and without punctuation around them
STAND_INS = frozenset(
    (
        "null", "none", "nil", "n/a", "na", "nan", "nothing", "empty", "blank", "undefined", "void", "missing",
        "tbd", "todo", "placeholder", "output", "answer", "response", "unknown", "no answer", "no response",
        "no output", "no content", "no summary", "no result", "no data", "not available", "not applicable",
        "answer here", "your answer here", "insert answer here", "sem resposta", "vazio", "nenhum", "nenhuma",
        "nada", "sin respuesta", "vacio", "ninguno", "ninguna", "aucun", "aucune", "vide", "sans reponse",
        "leer", "kein", "keine", "keine antwort",
    )
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_WORD = re.compile(r"[^\W_]+")
_SPACE = re.compile(r"\s+")
_BULLET = re.compile(r"^\s*(?:[-*•‣–]|\d+[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"”»')\]]*\s+|(?<=[。！？])")
_STOP = " .!?…。！？\"”»'`´([{<,;:-–—*"  # also marks that a cut leaves open
LETTER_LEAST, LETTER_GAP = 30, 1.0
_SHARE, _CODE = 1 << 30, (1 << 21) - 1


def is_empty(target: str | None) -> bool:
    if target is None:
        return True
    t = fold(target).strip()
    bare = _EDGE.sub("", t)
    return not bare or _SPACE.sub(" ", bare) in STAND_INS


def sentences(folded: str) -> list[str]:
    """Sentences of folded text: bullets count as one each, wrapped lines are joined."""
    lines = [x for x in folded.split("\n") if x.strip()]
    if lines and all(_BULLET.match(x) for x in lines):
        parts = [_BULLET.sub("", x) for x in lines]
    else:
        parts = [_SPACE.sub(" ", " ".join(lines))]
    out = []
    for p in parts:
        out += [s for s in (_SPACE.sub(" ", x).strip() for x in _SENTENCE.split(p)) if s]
    return out


def tail(parts: list[str]) -> str:
    return parts[-1].strip(_STOP) if parts else ""


class LetterModel:
    """How likely the letters of a text are, by counts of three letters in a row over ``n`` texts.

    ``shares`` are the same counts, each text's divided by its own number of them: they give the mean rate of the texts without a second pass.
    """

    def __init__(self, three: dict[str, int], shares: dict[str, float], n: int):
        self.three, self.two = three, Counter()
        for g, c in three.items():
            self.two[g[:2]] += c
        self.usual = math.fsum(w * self.log(g) for g, w in shares.items()) / max(1, n)

    def log(self, gram: str) -> float:
        return math.log((self.three.get(gram, 0) + 0.1) / (self.two.get(gram[:2], 0) + 4.0))

    def rate(self, words: list[str]) -> float:
        """Mean log probability of a letter after the two before it."""
        t = f" {' '.join(words)} "
        n = len(t) - 2
        return sum(self.log(t[i : i + 3]) for i in range(n)) / n if n > 0 else 0.0

    def is_far(self, words: list[str]) -> bool:
        return len(words) >= 4 and self.rate(words) < self.usual - LETTER_GAP


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three letters as one number, how often, the shares added up) over some texts. Shares are whole numbers of ``_SHARE``, so their sum has no order."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[:-2] == owner[2:]
    gram, at, n = np.unique(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[inside], return_inverse=True, return_counts=True)
    share = _SHARE // np.maximum(sizes - 2, 1)
    return gram, n, np.bincount(at, weights=share[owner[:-2][inside]], minlength=len(gram)).astype(np.int64)


def letter_models(df: DataFrame, source_col: str) -> dict[str, LetterModel]:
    """A model for each language that at least ``LETTER_LEAST`` of the sources are in."""

    def run(batches):
        for pdf in batches:
            by: dict[str, list[str]] = {}
            for t in pdf["t"]:
                f = fold(t)
                lang = guess_language(f)[0]
                if lang:
                    by.setdefault(lang, []).append(f" {' '.join(prose_words(f))} ")
            for lang, texts in by.items():
                gram, n, share = _grams(texts)
                yield pd.DataFrame({"lang": lang, "gram": np.append(gram, -1), "n": np.append(n, len(texts)), "share": np.append(share, 0)})

    rows = spread_out(df.where(F.trim(F.col(source_col)) != "").select(F.col(source_col).alias("t")))
    counts = rows.mapInPandas(run, "lang string, gram long, n long, share long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("share").alias("share"))
    by: dict[str, list] = {}
    for lang, gram, n, share in counts.collect():  # one row per language and three letters
        by.setdefault(lang, []).append((gram, n, share))
    models = {}
    for lang in sorted(by):
        total = next(n for g, n, _ in by[lang] if g < 0)
        if total >= LETTER_LEAST:
            named = [(chr(g >> 42) + chr(g >> 21 & _CODE) + chr(g & _CODE), n, w) for g, n, w in by[lang] if g >= 0]
            models[lang] = LetterModel({g: n for g, n, _ in named}, {g: w / _SHARE for g, _, w in named}, total)
    return models


def is_foreign(ft: str, fs: str, models: dict[str, LetterModel]) -> bool:
    lt, score = guess_language(ft)
    ls, _ = guess_language(fs)
    if lt and ls and lt != ls and score >= 1.5:
        return True
    if ls not in models:
        return False
    words = prose_words(ft)
    own = sum(w in _FUNCTION_SETS.get(ls, ()) for w in words)
    return own < 0.1 * len(words) and models[ls].is_far(words)


_FUNCTION_SETS = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}


def defect(source: str | None, target: str | None, models: dict[str, LetterModel] | None = None) -> str | None:
    """The first of the defects that a pair shows by itself, all but a cut."""
    if source is None or not source.strip():
        return None
    if is_empty(target):
        return "empty"
    fs, ft = fold(source), fold(target)
    ws, wt = Counter(_WORD.findall(fs)), Counter(_WORD.findall(ft))
    n_s, n_t = sum(ws.values()), sum(wt.values())
    if not n_s:
        return None
    shared = sum((ws & wt).values())
    grounded = shared / n_t if n_t else 0.0
    if grounded < 0.97:
        loose = []
        for p in sentences(ft):
            w = Counter(_WORD.findall(p))
            if sum((w & ws).values()) < 0.75 * max(1, sum(w.values())):
                loose.append(p)
        said = " ".join(loose)
        said = _SPACE.sub(" ", re.sub(r"['’`´]", " ", said))
        if said and REFUSALS.search(said):
            return "refusal"
    if shared >= 0.9 * n_s:
        return "copied"
    if grounded < 0.8 and is_foreign(ft, fs, models or {}):
        return "wrong_language"
    return None


def source_sentences(source: str) -> set[str]:
    """The sentences a response may have taken, wrapped lines joined or each line by itself, without their closing marks."""
    fs = fold(source)
    return {x for x in (s.strip(_STOP) for s in [*sentences(fs), *(s for line in fs.split("\n") for s in sentences(line))]) if x}


def length_spikes(df: DataFrame, target_col: str, reach: int = 24, ratio: float = 1.5, sure: float = 3.5) -> DataFrame:
    """(n_chars, n, around): lengths at which unfinished responses of five words or more pile up.

    The histogram is smoothed by the mean over ``reach`` lengths to either side, two next to it left out. A
    length is a spike if it has ``ratio`` times that mean or more and exceeds it by ``sure`` standard deviations of a count, alone or as the lower of two neighbours.
    One row per length is aggregated before any comparison.
    """
    t = F.rtrim(F.col(target_col))
    open_end = df.where(F.col(target_col).isNotNull() & ~t.rlike(r"[.!?…。！？\"”»)\]]$") & (F.size(F.split(F.trim(t), r"\s+")) >= 5))
    by = open_end.groupBy(F.length(target_col).alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    near = by.select(F.explode(F.sequence(F.col("n_chars") - reach, F.col("n_chars") + reach)).alias("n_chars"), F.col("n_chars").alias("of"), F.col("n").alias("m"))
    off = F.abs(F.col("n_chars") - F.col("of"))
    x = near.groupBy("n_chars").agg(
        F.coalesce(F.sum(F.when(off == 0, F.col("m"))), F.lit(0)).alias("n"),
        F.greatest(F.coalesce(F.sum(F.when(F.col("of") == F.col("n_chars") - 1, F.col("m"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("of") == F.col("n_chars") + 1, F.col("m"))), F.lit(0))).alias("beside"),
        (F.coalesce(F.sum(F.when(off > 2, F.col("m"))), F.lit(0)) / (2.0 * (reach - 2))).alias("around"),
    )
    high = lambda c: F.col(c) >= ratio * F.col("around")
    alone = F.col("n") - F.col("around") > sure * F.sqrt(F.col("around") + 1)
    pair = high("beside") & (2 * F.least("n", "beside") - 2 * F.col("around") > sure * F.sqrt(2 * F.col("around") + 1))
    x = x.where((F.col("n") > 0) & high("n") & (alone | pair))
    return x.select("n_chars", "n", F.round("around", 6).alias("around"))


def prefix_neighbours(texts: DataFrame) -> DataFrame:
    """(t, next) for every text that is a proper prefix of the next one. ``texts``: t, distinct.

    Texts are range-partitioned and sorted; if a text is a prefix of any other it is one of its
    successor. The first row of each partition is compared with the last of the one before it
    that is not empty, through a table with one row per partition.
    """
    ordered = texts.repartitionByRange("t").sortWithinPartitions("t").select("t", F.spark_partition_id().alias("part"))

    def run(batches):
        held = first = None
        part = -1
        for pdf in batches:
            cut, full = [], []
            for x, part in zip(pdf["t"], pdf["part"]):
                if held is None:
                    first = x
                elif x.startswith(held):
                    cut.append(held)
                    full.append(x)
                held = x
            yield pd.DataFrame({"t": cut, "next": full, "part": -1}).astype({"t": "object", "next": "object"})
        if first is not None:
            yield pd.DataFrame({"t": [held], "next": [first], "part": [part]})

    rows = materialize(ordered.mapInPandas(run, "t string, next string, part int"), "neighbours")
    follows = Window.orderBy("part")  # one row per partition that holds any text
    edge = rows.where("part >= 0").select("t", F.lead("next").over(follows).alias("next")).where("startswith(next, t)")
    return rows.where("part < 0").select("t", "next").union(edge)


def shortened_responses(df: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """(id, full_id): responses that are a proper prefix of the next response in text order."""
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.col(target_col), r"\s+", " "))), r"[.…\s]+$", "")
    texts = df.where(F.col(target_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), t.alias("t")).where("t <> ''")
    one = texts.groupBy("t").agg(F.min("id").alias("first_id"))
    found = prefix_neighbours(one.select("t")).join(one.select(F.col("t").alias("next"), F.col("first_id").alias("full_id")), "next")
    return texts.join(found, "t").select("id", "full_id")


def pair_defects(df: DataFrame, id_col: str, source_col: str, target_col: str) -> DataFrame:
    """(id, defect) for each defective pair."""
    spark = df.sparkSession
    spikes = frozenset(r[0] for r in length_spikes(df, target_col).select("n_chars").collect())  # at most one per length
    held = spark.sparkContext.broadcast((spikes, letter_models(df, source_col)))  # lengths, and letter counts of a few languages

    @F.pandas_udf("defect string, fragment string, open boolean, own array<string>")
    def judge(source: pd.Series, target: pd.Series) -> pd.DataFrame:
        at_spike, models = held.value
        out = []
        for s, t in zip(source, target):
            d = defect(s, t, models)
            own = sorted(source_sentences(s))
            last = tail(sentences(fold(t))) if d is None and s.strip() else ""
            stops = bool(last) and len(t) in at_spike and not t.rstrip().endswith((".", "!", "?", "。", "！", "？")) and last not in own and last in _SPACE.sub(" ", fold(s))
            out.append((d, last or None, stops, own))
        return pd.DataFrame(out, columns=["defect", "fragment", "open", "own"])

    rows = df.where(F.col(source_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).alias("s"), F.col(target_col).alias("t"))
    rows = materialize(spread_out(rows).select("id", judge("s", "t").alias("x")).select("id", "x.*"), "judged")
    fragments = rows.where("defect is null and fragment is not null")
    texts = fragments.select(F.col("fragment").alias("t"), F.lit(1).alias("f")).union(rows.select(F.explode("own").alias("t"), F.lit(0).alias("f")))
    texts = materialize(texts.groupBy("t").agg(F.max("f").alias("f")), "sorted")
    # a fragment that is no prefix of its neighbour shortens nothing in the corpus
    short = prefix_neighbours(texts.select("t")).select("t").join(texts.where("f = 1").select("t"), "t").withColumnRenamed("t", "fragment")
    cut = F.expr("not array_contains(own, fragment) and exists(own, x -> startswith(x, fragment))")
    truncated = fragments.join(short, "fragment", "left_semi").where(cut).select("id").union(fragments.where("open").select("id"))
    return rows.where("defect is not null").select("id", "defect").union(truncated.distinct().select("id", F.lit("truncated").alias("defect")))
