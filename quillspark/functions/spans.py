"""Spans, clauses and rule compression for one text; wrapped as Arrow-batched functions.

Masks are interval lists merged in one sweep, so a text costs time linear in its length
and the number of its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from quillspark.functions import grammar as g

Span = tuple[int, int]


def anchors(text: str) -> list[Span]:
    return [m.span() for m in g.ANCHORS_RE.finditer(text)]


def _ends(text: str) -> list[int]:
    """Positions just after each character that ends a sentence."""
    n = len(text)
    return [i + 1 for i, c in enumerate(text) if c in g.SENTENCE_STOPS or (c == "." and (i + 1 == n or text[i + 1] in " \t\n"))]


def sentence_of(text: str, ends: list[int], lo: int, hi: int) -> Span:
    """The sentence round [lo, hi): from the last end before it to the first end at or after ``hi``."""
    k = bisect_right(ends, lo)
    start = ends[k - 1] if k else 0
    while start < hi and text[start].isspace():
        start += 1
    k = bisect_left(ends, hi + 1)
    return start, ends[k] if k < len(ends) else len(text)


def _sentences_of(text: str, found: list[Span], most: int) -> list[Span]:
    ends, out = _ends(text), []
    for lo, hi in found:
        if out and lo < out[-1][1]:
            continue
        a, b = sentence_of(text, ends, lo, hi)
        if most and b - a > most:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def risk_sentences(text: str, most: int = 128) -> list[Span]:
    """Sentences round meaning-changing words; longer ones than ``most`` are left out (0: none is)."""
    return _sentences_of(text, [m.span() for m in g.RISK_RE.finditer(text)], most)


def anchor_sentences(text: str) -> list[Span]:
    out: list[Span] = []
    ends = _ends(text)
    for lo, hi in anchors(text):
        a, b = sentence_of(text, ends, lo, hi)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


class Overlaps:
    """Answers whether a range meets any of a set of spans, by binary search."""

    def __init__(self, spans: list[Span]):
        kept = sorted(s for s in spans if s[1] > s[0])
        self.starts = [a for a, _ in kept]
        self.far = list(accumulate((b for _, b in kept), max))

    def __call__(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.starts, hi)
        return k > 0 and self.far[k - 1] > lo


def clauses(text: str) -> list[Span]:
    out = []
    for m in g.CLAUSE_RE.finditer(text):
        a, b = m.span()
        body = text[a:b]
        a += len(body) - len(body.lstrip())
        b -= len(body) - len(body.rstrip())
        if a < b:
            out.append((a, b))
    return out


def _drop(text: str, cuts: list[Span]) -> str:
    parts, at = [], 0
    for a, b in sorted(cuts):
        if a > at:
            parts.append(text[at:a])
        at = max(at, b)
    parts.append(text[at:])
    return "".join(parts)


def tidy(text: str) -> str:
    rows = []
    for row in text.split("\n"):
        body = row.lstrip(" \t")
        rows.append(row[: len(row) - len(body)] + re.sub(r"[ \t]+", " ", body).rstrip() if body else "")
    t = re.sub(r"\n{3,}", "\n\n", "\n".join(rows))
    t = re.sub(r"[ \t]+(?=[,;:!?]|\.(?![A-Za-z_]))", "", t)
    t = re.sub(r"([,;])(?:\s*[,;])+", r"\1", t)
    return re.sub(r"(\A|\n)\s*[,;:]\s*", r"\1", t).strip()


def token_count(text: str) -> int:
    return sum(1 for _ in g.TOKEN_RE.finditer(text))


def compress_rules(text: str) -> str:
    """Drop repeated sentences and lines, and fillers outside anchors; then tidy."""
    seen: set[tuple[str, ...]] = set()
    cuts: list[Span] = []
    for m in g.UNIT_RE.finditer(text):
        words = tuple(re.findall(r"\w+", m[0].casefold()))
        if words and words in seen:
            cuts.append(m.span())
        seen.add(words)
    held = Overlaps(anchors(text))
    cuts += [m.span() for m in g.FILLERS_RE.finditer(text) if not held(*m.span())]
    return tidy(_drop(text, cuts))


def render(text: str, parts: list[Span], keep: list[bool]) -> str:
    """The kept clauses with the text's own separators; a gap left by dropped clauses is a newline or a blank."""
    out, last = [], None
    for k, (a, b) in enumerate(parts):
        if not keep[k]:
            continue
        if last is not None:
            gap = text[parts[last][1] : a]
            out.append(gap if last + 1 == k and not gap.strip() else "\n" if "\n" in gap else " ")
        out.append(text[a:b])
        last = k
    return "".join(out)


def keep_table_heads(texts: list[str], keep: list[bool]) -> list[bool]:
    """Where any row of a block of table rows is kept, its first two rows are kept too."""
    row = [t.lstrip().startswith("|") for t in texts] + [False]
    out, begin = list(keep), None
    for k, is_row in enumerate(row):
        if is_row and begin is None:
            begin = k
        elif not is_row and begin is not None:
            if any(keep[begin:k]):
                out[begin : min(begin + 2, k)] = [True] * (min(begin + 2, k) - begin)
            begin = None
    return out


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end); a stop at the end of an address or a path is a token of its own."""
    out = []
    for m in g.PAIR_TOKEN_RE.finditer(text):
        v, (a, b) = m[0], m.span()
        if v[0] == "/" or v.startswith("http"):
            if v[-1] in ".,;!?":
                out += [(v[:-1], a, b - 1), (v[-1], b - 1, b)]
                continue
        out.append((v, a, b))
    return out


_STATUS = [re.compile(rf"(?<!\w){p}(?!\w)", re.I) for p in g.STATUS.values()]
_FAIL = re.compile(rf"(?<!\w){g.STATUS['fail']}(?!\w)", re.I)
_NARRATION = re.compile(rf"(?<!\w){g.NARRATION}(?!\w)", re.I)
_LABEL = re.compile(g.LABEL)
_PASS = re.compile(g.PASS_ROW, re.I)


def checkpoint_keep(clause: str, anchored: bool) -> bool:
    """Whether a clause belongs in a checkpoint: status always, anchors unless it is noise, a bare label or narration."""
    bare = clause.strip()
    if re.fullmatch(r"\.{2,}", bare) or (_PASS.match(bare) and not _FAIL.search(bare)):
        return False
    if any(p.search(clause) for p in _STATUS):
        return True
    return anchored and not _LABEL.match(bare) and not _NARRATION.search(clause)
