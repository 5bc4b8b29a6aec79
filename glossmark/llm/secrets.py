"""Secret scan: fixed patterns, plus sliding-window Shannon entropy per character class with an allow list."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from glossmark.llm.common import map_rows, spans_text, texts_of

KINDS = ["assign", "access", "hex", "entropy"]

# Fixed patterns of the base scan. Letters of the keywords in either case, by ASCII alone.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of the class is one match, so a shorter match is a run that fails

#: A candidate is a run of these characters of at least the window length that holds a digit.
WINDOW = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}")
_DIGIT = re.compile(r"[0-9]")


@dataclass(frozen=True)
class EntropyClass:
    """A character class with the bits per character that a window must reach, the kinds of characters that it must mix, and how
    often letters and digits must change places in it: words with a number behind them change once or twice, random ones often."""

    name: str
    run: re.Pattern
    bits: float
    mix: tuple[re.Pattern, ...]
    changes: int = 0


_LOWER, _UPPER, _LETTER, _HEX_LETTER = map(re.compile, ("[a-z]", "[A-Z]", "[A-Za-z]", "[a-fA-F]"))
_CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
CLASSES = (
    EntropyClass("hex", re.compile(rf"[0-9a-fA-F]{{{WINDOW},}}"), 2.6, (_DIGIT, _HEX_LETTER), 3),
    EntropyClass("one case", re.compile(rf"(?:[0-9a-z]{{{WINDOW},}}|[0-9A-Z]{{{WINDOW},}})"), 3.2, (_DIGIT, _LETTER), 4),
    EntropyClass("alnum", re.compile(rf"[0-9A-Za-z]{{{WINDOW},}}"), 3.4, (_DIGIT, _LOWER, _UPPER), 2),
    EntropyClass("base64", re.compile(rf"[0-9A-Za-z+/_=-]{{{WINDOW},}}"), 3.5, (_DIGIT, _LOWER, _UPPER), 2),
)

#: Windows that look random and are not: counting runs, identifiers of a public form, words that mark an example.
ALLOW_LIST = (
    re.compile(r"0123456789|123456789a|abcdefghij", re.IGNORECASE),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"example|placeholder|changeme|your[-_]", re.IGNORECASE),
)

_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each base kind; failing ones are dropped without another try."""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def random_windows(run: str, bits: float) -> list[tuple[int, int]]:
    """The united windows of ``run`` whose entropy reaches ``bits``; each step updates two counts."""
    counts: dict[str, int] = {}
    total, out = 0.0, []
    most = WINDOW * (math.log2(WINDOW) - bits)  # entropy = log2(w) - sum(c log2 c) / w
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += _C_LOG_C[n + 1] - _C_LOG_C[n]
        counts[c] = n + 1
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            total += _C_LOG_C[n - 1] - _C_LOG_C[n]
            counts[gone] = n - 1
        if i >= WINDOW - 1 and total <= most + 1e-9:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def entropy_spans(text: str, allow: tuple[re.Pattern, ...] = ALLOW_LIST) -> list[tuple[int, int]]:
    """Spans of candidate strings that are random in any class and that no allow-list pattern touches, overlaps united."""
    found = []
    for cand in _CANDIDATE.finditer(text) if _DIGIT.search(text) else ():
        if not _DIGIT.search(cand[0]):
            continue
        allowed = [m.span() for p in allow for m in p.finditer(cand[0])]
        for cls in CLASSES:
            for run in cls.run.finditer(cand[0]):
                for a, b in random_windows(run[0], cls.bits):
                    a, b = a + run.start(), b + run.start()
                    random = all(p.search(cand[0], a, b) for p in cls.mix) and len(_CHANGE.findall(cand[0], a, b)) >= cls.changes
                    if random and not any(x < b and a < y for x, y in allowed):
                        found.append((a + cand.start(), b + cand.start()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str | None, allow: tuple[re.Pattern, ...] = ALLOW_LIST) -> tuple[list, list]:
    """Base spans, and the method's spans that no base span overlaps."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, [("entropy", a, b) for a, b in entropy_spans(text, allow) if not any(x < b and a < y for _, x, y in base)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[re.Pattern, ...] = ALLOW_LIST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base spans), base_spans and spans: one row per row of ``docs``, without a shuffle.

    Whole texts are scanned; offsets are code points, ends exclusive. A null or empty text has no spans (empty strings).
    Null ids and repeated rows are kept as they are. An empty table gives an empty result.
    """

    def batch(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_spans", "spans")}
        for t in texts:
            base, more = scan(t, allow)
            for k in KINDS[:3]:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base_spans"].append(spans_text(base, KINDS))
            out["spans"].append(spans_text(base + more, KINDS))
        return {"doc_id": ids} | out

    return map_rows(texts_of(docs, id_col, text_col), "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string", batch)
