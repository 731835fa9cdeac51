"""Secret scans (operator 4): fixed patterns, and a randomness test battery for keys that no pattern names.

Candidates are the maximal runs of key characters, cut at inner '=', and the parts of each between separators. The
encoding is inferred (hex, base32, base62, base64), and the symbols go through chi-squared uniformity, runs above and
below the middle, and serial correlation. A structured word fails them. Evidence that a run isn't text is the likelihood
ratio between uniform symbols and the likelier of two models of text: letters by their shares, and words, numbers and
names that rarely change between lower case, capitals and digits. Its inverse is a valid p-value at every length, so
short runs need stronger evidence. The battery's three p-values are combined (Cauchy's rule), and a candidate's p-value is
divided by the result: one that the battery finds less random needs more evidence by that factor. Within a document the discoveries are chosen by Benjamini and Hochberg's rule over
all candidates, plain words too, which controls their false share; of overlapping ones that with most evidence stays.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, chunks, text_bytes

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Fewest symbols of a candidate: four uniform ones give about the evidence that the rule asks of a lone candidate.
LEAST_SYMBOLS = 4
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: The runs but plain words and numbers, whose p-value is over any rate; words of a to f alone are looked at.
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?!(?:(?![a-f]+(?![a-z]))[a-z]+|[A-Z][a-z]+|(?![A-F]+(?![A-Z]))[A-Z]{1,60}|[0-9]+)(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{4,}")
#: Cuts of a run: a path's names, a slug's words, both, and all signs.
_CUTS = tuple(re.compile(x) for x in ("[^/]+", "[^_-]+", "[^/_-]+", "[^/+_-]+"))
_WORDS = (b"passw", b"secret", b"token", b"api")
#: Share of each letter a to z in running text, in hundredths of a percent.
_LETTERS = (820, 150, 280, 430, 1270, 220, 200, 610, 700, 15, 77, 400, 240, 670, 750, 190, 10, 600, 630, 910, 280, 98, 240, 15, 200, 7)
_TEXT = {chr(97 + i): 0.86 * x / sum(_LETTERS) for i, x in enumerate(_LETTERS)} | {chr(65 + i): 0.05 * x / sum(_LETTERS) for i, x in enumerate(_LETTERS)} | {c: 0.05 / 10 for c in "0123456789"} | {c: 0.04 / 5 for c in "+/_=-"}
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Natural logarithms by byte: the share in text, and a symbol's share in its class (lower case, capital, digit, sign).
_KIND = np.full(256, 3)
_LOG_TEXT, _LOG_IN_KIND = np.full(256, math.log(0.04 / 5)), np.full(256, -math.log(5))
for _c, _p in _TEXT.items():
    _kind = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3
    _KIND[ord(_c)], _LOG_TEXT[ord(_c)], _LOG_IN_KIND[ord(_c)] = _kind, math.log(_p), -math.log((26, 26, 10, 5)[_kind])
#: Natural logarithms of the chance of each class after each; behind a sign a new word starts.
_LOG_NEXT = np.log(np.array([[0.75, 0.05, 0.05, 0.15], [0.05, 0.75, 0.05, 0.15], [0.05, 0.05, 0.75, 0.15], [0.3, 0.3, 0.3, 0.1]]))
_PLACE = {k: {c: i for i, c in enumerate(a)} for k, a in _ALPHABETS.items()}


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run (padding aside); None if none does."""
    body = set(run.rstrip("="))
    return next((k for k, p in _PLACE.items() if body and body <= p.keys()), None)


def battery(run: str, encoding: str) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity (16 classes at most), runs about the middle and lag-1 serial correlation."""
    place, size = _PLACE[encoding], len(_ALPHABETS[encoding])
    x = np.array([place[c] for c in run.rstrip("=")], float)
    n, classes = len(x), min(16, size)
    count = np.bincount((x * classes // size).astype(int), minlength=classes)
    edges = np.ceil(np.arange(classes + 1) * size / classes)
    expected = n * np.diff(edges) / size
    chi, df = float(((count - expected) ** 2 / expected).sum()), classes - 1
    uniform = _upper_tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    above = x >= size / 2
    a = int(above.sum())
    b, changes = n - a, int(np.count_nonzero(above[1:] != above[:-1])) + 1
    if a and b and n > 2:
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        runs = 2 * _upper_tail(abs(changes - mean) / spread)
    else:
        runs = 2.0 ** (1 - n)
    d = x - x.mean()
    total = float((d * d).sum())
    serial = 2 * _upper_tail(abs(float((d[1:] * d[:-1]).sum()) / total) * math.sqrt(n)) if total else 0.0
    return uniform, runs, serial


def combined(p_values: tuple[float, ...]) -> float:
    """One p-value of several that may depend on each other, by the mean of their Cauchy quantiles."""
    t = sum(math.tan((0.5 - min(1 - 1e-12, max(1e-15, p))) * math.pi) for p in p_values) / len(p_values)
    return max(1e-15, 0.5 - math.atan(t) / math.pi)


def candidate_p_value(part: str, encoding: str) -> float:
    """The bound on text's chance, over how well the part passes as uniform symbols; at least the former, so valid too."""
    bound = text_p_value(part, encoding)
    return min(1.0, bound / combined(battery(part, encoding))) if bound < 1 else 1.0


def text_p_value(run: str, encoding: str) -> float:
    """Bound on the chance that text looks this random: the inverse likelihood ratio against uniform symbols.

    The alphabets count as equally likely, which pays for taking the one that fits.
    """
    x = np.frombuffer(run.rstrip("=").encode(), np.uint8)
    kinds = _KIND[x]
    words = _LOG_NEXT[3, kinds[0]] + _LOG_NEXT[kinds[:-1], kinds[1:]].sum() + _LOG_IN_KIND[x].sum()
    uniform = -len(x) * math.log(len(_ALPHABETS[encoding])) - math.log(len(_ALPHABETS))
    return math.exp(-min(700.0, max(0.0, uniform - max(float(words), float(_LOG_TEXT[x].sum())))))


def candidate_parts(run: str) -> list[tuple[int, int]]:
    """(start, end) in a run of the parts to test: those between inner '=' signs, and their parts between separators."""
    body, out = len(run.rstrip("=")), set()
    for m in re.finditer("[^=]+", run):
        spans = {m.span(), *((m.start() + c.start(), m.start() + c.end()) for cut in _CUTS for c in cut.finditer(m.group()))}
        out |= {(s, len(run) if e == body else e) for s, e in spans if e - s >= LEAST_SYMBOLS}
    return sorted(out)


def random_spans(text: str, rate: float = 0.01) -> list[tuple[int, int]]:
    """Parts found random: their p-values, by evidence against text and by the battery, pass at false rate ``rate``."""
    found, mixed = [], 0
    for m in _MIXED.finditer(text):
        mixed += 1
        for s, e in candidate_parts(m.group()):
            part = m.group()[s:e]
            encoding = infer_encoding(part)
            if encoding:
                found.append((candidate_p_value(part, encoding), -len(part), m.start() + s, m.start() + e))
    if not found:
        return []
    found.sort()
    tested = len(found) + len(_RUN.findall(text)) - mixed
    passed = max((i for i, f in enumerate(found, 1) if f[0] <= rate * i / tested), default=0)
    starts, ends = [], []  # of the spans that stay, in order; they don't overlap
    for _, _, s, e in found[:passed]:
        at = bisect_left(starts, s)
        if (not at or ends[at - 1] <= s) and (at == len(starts) or e <= starts[at]):
            starts.insert(at, s)
            ends.insert(at, e)
    return list(zip(starts, ends, strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans that overlap none of them), each (kind, start, end) in code points."""
    base = base_spans(text)
    return base, added_spans(text, base)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Random spans that overlap no base span; both in order are walked once."""
    out, taken, i, reach = [], sorted((s, e) for _, s, e in base), 0, -1
    for s, e in random_spans(text):
        while i < len(taken) and taken[i][0] < e:
            reach, i = max(reach, taken[i][1]), i + 1
        if reach <= s:
            out.append(("random", s, e))
    return out


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


_IN_RUN = np.zeros(256, bool)
_IN_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def _worth_a_look(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can hold a base span at all: a run of 20 key characters, or one of the fixed words. Exact, whole texts."""
    out = np.zeros(len(offsets) - 1, bool)
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]]
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = _IN_RUN[raw]
        flips = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = flips[::2], flips[1::2]
        long = end - begin >= 20  # runs over a text's end are looked at too; the texts' own scan decides
        for s, e in zip(begin[long], end[long], strict=True):
            out[i + np.searchsorted(at, s, "right") - 1 : i + np.searchsorted(at, e, "left")] = True
        low = raw.tobytes().lower()
        for w in _WORDS:
            k = low.find(w)
            while k >= 0:
                r = int(np.searchsorted(at, k, "right")) - 1
                out[i + r] = True
                k = low.find(w, int(at[r + 1]) if k + 1 < at[r + 1] else k + 1)
    return out


def scan_secrets(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, and with ``with_text`` the found strings.

    ``docs`` needs doc_id and text; other columns are ignored. Spans are kind:start:end in code points. A null text counts
    as empty: no spans, the digest of nothing. Of overlapping random candidates that with most evidence stays, then the
    longer, then the first. Very long texts are scanned whole. Repeated rows each get a row; an empty table gives an empty
    result.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string" + (", found array<string>" if with_text else "")
    empty = hashlib.sha256(b"").hexdigest()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            look = _worth_a_look(*text_bytes(b.column(1))).tolist()
            n, digest, joined, strings = {k: [] for k in KINDS}, [], [], []
            for r, yes in enumerate(look):
                text = b.column(1)[r].as_py() or ""
                base = base_spans(text) if yes else []
                added = added_spans(text, base)
                for k in KINDS:
                    n[k].append(sum(x[0] == k for x in (*base, *added)))
                digest.append(hashlib.sha256(join_spans(base).encode()).hexdigest() if base else empty)
                joined.append(join_spans([*base, *added]))
                strings.append([text[s:e] for _, s, e in sorted([*base, *added], key=lambda x: x[1])])
            columns = [b.column(0), *(pa.array(n[k], pa.int64()) for k in KINDS), pa.array(digest, pa.string()), pa.array(joined, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            if with_text:
                columns.append(pa.array(strings, pa.list_(pa.string())))
                names.append("found")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
