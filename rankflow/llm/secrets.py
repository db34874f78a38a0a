"""Secret scans: fixed patterns plus values in credential context that a guess-cost model finds hard to guess.

The cost of a value is the least sum, over all ways to cut it into words, dates, repeats, keyboard walks and brute-force
spans, of the log10 guesses of the spans. Words are ranked by a public tokenizer's vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from math import inf, log10

import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.common import fresh_name, prepare

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Wider credential context, with the value that follows; quoted values may hold spaces.
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|(?:api|access|private|client|secret|encryption|signing|account)[_\-\x20]?key)(?![a-z])"
    r"[\"']?\x20*(?:[:=]+>?|\bis\b)\x20*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"'<>,;]{6,}))",
    re.I | re.A,
)
#: Values that cost at least this many log10 guesses are secrets.
LEAST_COST = 9.0
#: Extra log10 guesses for each span: where the cut is must be guessed too.
CUT_COST = 0.3
#: Copies that a repeat may have: up to so many, a power of two, or as many as there are.
COPIES = 64
#: Characters of a date, at most.
DATE_CHARS = 10
_ROWS = ("`1234567890-=", "\tqwertyuiop[]\\", "\0asdfghjkl;'", "\0zxcvbnm,./")
_COMMON = "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou changeme default secret test user root pass example".split()
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
_LEET = str.maketrans("@4310$5!7", "aaeiossit")


def _neighbours() -> dict[str, set[str]]:
    at = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row) if c > "\t"}
    return {a: {b for b, (r, k) in at.items() if a != b and abs(r - at[a][0]) <= 1 and abs(k - at[a][1]) <= 1} for a in at}


_NEXT = _neighbours()


@lru_cache(maxsize=4)
def word_ranks(vocabulary_path: str) -> dict[str, int]:
    """Whole lower-case words of three letters or more with their ranks; as many as the vocabulary file has at most."""
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks: dict[str, int] = {w: k + 1 for k, w in enumerate(_COMMON)}
    for token in sorted(vocabulary, key=vocabulary.get):
        word = token.removesuffix("</w>")
        if token.endswith("</w>") and len(word) > 2 and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _alphabet(c: str) -> float:
    if c.isdigit():
        return 1.0
    return log10(26) if c.isascii() and c.isalpha() else log10(33) if c.isascii() else log10(100)


def word_cost(own: str, ranks: dict[str, int]) -> float | None:
    """Log10 guesses of a word as it is written, None if it is none: its rank, its capitals, its digits for letters."""
    low = own.lower()
    found = []
    for text, swapped in ((low, 0.0), (low.translate(_LEET), 0.3)):
        if text in ranks and (not swapped or text != low):
            capitals = 0.0 if own == low else 0.3 if own[1:] == low[1:] or own.isupper() else 0.3 * sum(map(str.isupper, own))
            found.append(log10(ranks[text]) + capitals + swapped)
    return min(found, default=None)


def copies(most: int) -> list[int]:
    """How often a repeat may copy its unit if it is found ``most`` times more."""
    return sorted({*range(1, min(most, COPIES) + 1), *(1 << k for k in range(most.bit_length())), most} - {0})


def repeats_at(low: str, at: int, seen: list[int]) -> list[tuple[int, int]]:
    """Units that end at ``at`` and come again there: ``(period, times more)`` of each that is no repeat itself.

    ``seen`` has the earlier positions of the two characters at ``at``, in order.
    """
    found: list[tuple[int, int]] = []
    n, least = len(low), 1

    def judge(p):
        """How far what has period ``p`` reaches to the left and right of ``at``, if it comes again."""
        if low[at - p : at] != low[at : at + p]:
            return 0
        right = p
        while low.startswith(low[at : at + p], at + right) and at + right < n:
            right += p
        left = p
        while left + p <= at and low.startswith(low[at - p : at], at - left - p):
            left += p
        found.append((p, right // p))
        return min(left, right)

    if at and at < n and low[at - 1] == low[at]:
        least = judge(1) + 1
    for k in range(len(seen) - 1, -1, -1):
        p = at - seen[k]
        if p >= max(2, least):
            if at + p > n:
                break
            reach = judge(p)
            if reach:
                least = max(least, reach + 1)
    return [(p, m) for p, m in found if not any(p % q == 0 and low[at - p : at] == low[at - q : at] * (p // q) for q, _ in found if q < p)]


def guess_cost(value: str, ranks: dict[str, int], longest: int = 40, limit: float = inf) -> float:
    """Log10 guesses of the cheapest segmentation of ``value``, by dynamic programming over positions.

    A span is a word of ``ranks`` (three letters up to ``longest``), a date, a keyboard walk of three keys or more, a
    repeat of the characters before it (of a unit that is no repeat itself, two equal characters at least with it),
    or brute force. Each costs ``CUT_COST`` besides its own. Starts and ends of all kinds are tried everywhere. With a
    ``limit``, positions that cost as much are not followed, and the search ends when the value is known to cost less
    (then the result is some cost below the limit) or that much: a value without structure is given up after a few
    characters, however long it is.
    """
    low, n = value.lower(), len(value)
    best, brute = {0: 0.0}, {}
    places: dict[str, list[int]] = {}
    last = 0  # the furthest position that is reached

    def reach(j, cost):
        nonlocal last
        if cost < limit and cost < best.get(j, inf):
            best[j] = cost
            last = max(last, j)

    for i in range(n):
        if i > last and i not in brute:
            break
        here = best.pop(i, inf) if i else 0.0
        # Brute force goes on, or begins here.
        step = min(brute.pop(i, inf), here + CUT_COST) + _alphabet(value[i])
        if step < limit:
            brute[i + 1] = step
            reach(i + 1, step)
        if here < limit:
            start = here + CUT_COST
            for size in range(3, min(n - i, longest) + 1):
                cost = word_cost(value[i : i + size], ranks)
                if cost is not None:
                    reach(i + size, start + cost)
            if low[i].isdigit():
                for j in range(i + 4, min(n, i + DATE_CHARS) + 1):
                    if _DATE.fullmatch(low, i, j):
                        reach(j, start + log10(365 * 100))
            j = i + 1
            while j < n and low[j] in _NEXT.get(low[j - 1], ()) and start + log10(47) + 0.45 * (j - i) < limit:
                j += 1
                if j - i >= 3:
                    reach(j, start + log10(47) + 0.45 * (j - i - 1))
            for p, most in repeats_at(low, i, places.get(low[i : i + 2], [])):
                for m in copies(most):
                    if p * (m + 1) >= 3:
                        reach(i + p * m, start + log10(1 + m))
            if best.get(n, inf) < limit < inf:
                return best[n]
        places.setdefault(low[i : i + 2], []).append(i)
    return min(best.get(n, inf), limit) if n else 0.0


def find(text: str, ranks: dict[str, int], least_cost: float = LEAST_COST) -> list[tuple[int, str, int]]:
    """All spans ``(start, kind, end)`` in code points, sorted by start, then by kind as listed.

    A span of the fixed patterns is the whole match; of kind ``guess`` it is the value alone, and values that a span of
    the fixed patterns covers are not reported again.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base, at, covered = sorted(found), 0, 0
    for m in _CONTEXT.finditer(text):
        k = m.lastindex
        if not k:
            continue
        while at < len(base) and base[at][0] <= m.start(k):  # both come by rising start
            covered = max(covered, base[at][2])
            at += 1
        if m.end(k) > covered and guess_cost(m[k], ranks, limit=least_cost) >= least_cost:
            found.append((m.start(k), 3, m.end(k)))
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(documents: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", least_cost: float = LEAST_COST) -> DataFrame:
    """Secrets of every whole text, one row per row of ``documents``.

    Columns: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``n_guess``, ``base_sha256``, ``spans``. A null text is
    empty and has none; repeated rows are repeated; null ids stay; an empty table gives an empty result; other columns
    are ignored, so clashing names do no harm.
    """
    prepare(documents.sparkSession)
    source = documents.select(documents[id_col].alias("doc_id"), documents[text_col].alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_guess bigint, base_sha256 string, spans string"

    def run(batches):
        ranks = word_ranks(vocabulary_path)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                spans = find(value.as_py() or "", ranks, least_cost)
                kinds = [k for _, k, _ in spans]
                base = _join(x for x in spans if x[1] != "guess")
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), _join(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return source.mapInArrow(run, schema)


def masked(text: str, ranks: dict[str, int], least_cost: float = LEAST_COST) -> str:
    """``text`` with every span replaced by the name of its kind; overlapping spans are replaced as one."""
    out, end, kind, start = [], 0, "", None
    for s, k, e in find(text, ranks, least_cost):
        if start is not None and s < end:
            end = max(end, e)
            continue
        if start is not None:
            out.append(f"[{kind} removed]")
        out.append(text[end:s])
        start, kind, end = s, k, e
    if start is None:
        return text
    return "".join([*out, f"[{kind} removed]", text[end:]])


def mask(documents: DataFrame, vocabulary_path: str, text_col: str = "text", count_col: str | None = "n_chars") -> DataFrame:
    """``documents`` with its secrets masked in ``text_col`` and ``count_col`` as long as the new text; nulls stay null."""
    prepare(documents.sparkSession)
    old = fresh_name(documents.columns, "_masked")

    @F.pandas_udf("string")
    def cleaned(texts):
        ranks = word_ranks(vocabulary_path)
        return texts.map(lambda t: t if t is None else masked(t, ranks))

    cleaned = cleaned.asNondeterministic()  # else the optimizer computes it once for each use
    out = documents.withColumn(old, cleaned(F.col(f"`{text_col}`")))
    named = [F.col(old).alias(c) if c == text_col else F.length(old).cast(documents.schema[c].dataType).alias(c) if c == count_col else F.col(f"`{c}`") for c in documents.columns]
    return out.select(*named)
