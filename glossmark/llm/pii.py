"""Personal data: fixed patterns, plus a character-level BiLSTM-CRF over overlapping windows, reconciled over the whole text."""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glossmark.llm.common import map_rows, spans_text, texts_of
from glossmark.llm.tagger import Tagger, char_ids

KINDS = ["email", "ip", "card", "phone"]

# Fixed patterns of the base scan, in forms that read every character a bounded number of times: a match can only start where
# a run starts, as every later start of the run meets the same rest.
_EMAIL_REST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Windows of the tagger, and how far two neighbours overlap.
WINDOW, OVERLAP = 96, 32
#: Parameters of the training: rows that are labelled, and passes over them.
TRAINING_ROWS, EPOCHS = 1200, 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = (ord(d) - 48) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; failing ones are dropped without another try."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if (m := _EMAIL_REST.match(text, at)) and at > end and text[at - 1] in _EMAIL_LOCAL:
            start = at - 1
            while start > end and text[start - 1] in _EMAIL_LOCAL:
                start -= 1
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- labelled rows and training


def labelled_rows(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` made-up texts with the spans of their personal data, from templates; also look-alikes without a label."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda k: "".join(pick("abcdefghijklmnoprstuvwyéüñ"[:23]) for _ in range(k))

    def word() -> str:
        w = "".join(pick(["th", "er", "on", "an", "re", "ti", "en", "le", "ou", "é", "ch", "ung", "de", "la", "ció", "st", "ing"]) for _ in range(int(rng.integers(1, 5))))
        return (w.capitalize() if rng.random() < 0.1 else w) + pick(["", "", "", "", ".", ","])

    def email() -> str:
        part = lambda lo, hi: letters(int(rng.integers(lo, hi)))
        local = pick(["", "", digits(1)]).join([part(1, 9), *(pick("._-+") + part(1, 7) for _ in range(pick([0, 0, 1, 1, 2])))]) + pick(["", "", digits(2), digits(4)])
        host = part(2, 9) + pick(["", "", "", digits(1), "-" + part(2, 7)])
        return f"{local}@{host}{pick(['', '', '.' + part(2, 8)])}.{pick(['com', 'org', 'net', 'de', part(2, 5), part(2, 4) + '.' + part(2, 3)])}"

    def card() -> str:
        body = pick("3456") + digits(14)
        full = body + next(d for d in "0123456789" if luhn(body + d))
        sep = pick(["", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    make = {
        "email": email,
        "ip": lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": lambda: pick([f"+{pick('12346789')} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]),
    }
    alike = [
        lambda: f"{digits(1)}.{digits(1)}.", lambda: digits(int(rng.integers(1, 6))), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}",
        lambda: "".join(pick("0123456789abcdef") for _ in range(int(rng.integers(16, 41)))), lambda: f"{digits(2)}%", lambda: f"AKIA{''.join(pick('ABCDEFGHIJKLMNOP0123456789') for _ in range(16))}",
        lambda: f"v{digits(1)}.{digits(2)}.{digits(1)}", lambda: f"password={digits(3)}{letters(6)}{digits(4)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}", lambda: f"@{letters(6)}",
    ]
    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(rng.integers(6, 16))):
            u = rng.random()
            if u < 0.16:
                kind = pick(KINDS)
                piece = make[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += pick(alike)() if u < 0.26 else word()
            text += pick([" ", " ", " ", " ", "\n", ". ", ", "])
        rows.append((text, spans))
    return rows


def encode_rows(rows: list, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags of the first ``steps`` characters of labelled rows, padded."""
    chars, tags = np.zeros((len(rows), steps), np.int16), np.zeros((len(rows), steps), np.int64)
    for i, (text, spans) in enumerate(rows):
        ids = char_ids(text)[:steps]
        chars[i, : len(ids)] = ids
        for kind, a, b in spans:
            k = KINDS.index(kind)
            tags[i, a:b] = 2 + 2 * k
            if a < steps:
                tags[i, a] = 1 + 2 * k
    return chars, tags


def train(rows: int = TRAINING_ROWS, epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """A tagger trained from ``rows`` labelled rows."""
    return Tagger.fresh(tuple(KINDS)).fit(*encode_rows(labelled_rows(rows, seed), 64), epochs=epochs)


@functools.lru_cache(maxsize=4)
def trained(spark: SparkSession, rows: int = TRAINING_ROWS, epochs: int = EPOCHS, seed: int = 3) -> Tagger:
    """``train`` in one task of the cluster, once a session; the weights (about 60 KB) come to the driver."""

    def run(_: object) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"w": [pickle.dumps(train(rows, epochs, seed).w)]})

    return Tagger(tuple(KINDS), pickle.loads(spark.range(1).coalesce(1).mapInArrow(run, "w binary").head()[0]))


# ---- decoding


def active_windows(text: str) -> np.ndarray:
    """Starts of the windows on a fixed grid that hold a digit or an at sign.

    Every kind needs one of these characters (``plausible`` drops spans without one), so a span that counts lies in these windows or goes on
    from them into their neighbours, which ``tagged_spans`` then decodes, too.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    stride = WINDOW - OVERLAP
    last = at // stride
    # The overlap gives a position a second window, the one before.
    first = np.maximum(last - 1, 0)[(at % stride) < OVERLAP]
    return np.unique(np.concatenate([last, first])) * stride


def plausible(kind: str, found: str) -> bool:
    """What a span of the tagger must hold to be kept: digits in a number the kind can have, a valid check digit, an at sign."""
    n = sum(c in "0123456789" for c in found)
    if kind == "email":
        return "@" in found[1:-1] and "." in found
    if kind == "ip":
        return 4 <= n <= 12 and found.count(".") == 3
    if kind == "card":
        return 13 <= n <= 19 and luhn("".join(c for c in found if c in "0123456789"))
    return 7 <= n <= 15


def tagged_spans(tagger: Tagger, texts: list[str], batch: int = 2048) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of every text.

    Each window is decoded alone. A position that two windows cover takes its tag from the one whose edge is farther away; then
    spans are read from the whole text's tags, so that a span across windows is one. Spans lose white space and stops at their
    ends, and those that are not ``plausible`` are dropped.
    """
    jobs = [(i, int(s)) for i, t in enumerate(texts) if t and (_DIGIT.search(t) or "@" in t) for s in active_windows(t)]
    ids = {i: char_ids(texts[i]) for i in {i for i, _ in jobs}}
    tags = {i: np.zeros(len(x), np.int8) for i, x in ids.items()}
    half, stride = OVERLAP // 2, WINDOW - OVERLAP
    done = set(jobs)
    while jobs:
        met = set()
        for a in range(0, len(jobs), batch):
            part = jobs[a : a + batch]
            chars = np.zeros((len(part), WINDOW), np.int16)
            for k, (i, s) in enumerate(part):
                piece = ids[i][s : s + WINDOW]
                chars[k, : len(piece)] = piece
            for (i, s), got in zip(part, tagger.decode(chars)):
                # The grid's windows overlap by OVERLAP; each owns its part up to the middle of the overlaps.
                n, begin = len(tags[i]), s + (0 if s == 0 else half)
                end = n if n <= s + WINDOW else s + WINDOW - half
                tags[i][begin:end] = got[begin - s : end - s]
                # A span at the edge of what a window owns goes on in the next one.
                if s and begin < n and tags[i][begin]:
                    met.add((i, s - stride))
                if end < n and tags[i][end - 1]:
                    met.add((i, s + stride))
        jobs = sorted(met - done)
        done |= met
    out: list[list] = [[] for _ in texts]
    for i, t in tags.items():
        text = texts[i]
        kind = np.where(t > 0, (t + 1) // 2, 0)
        cut = np.flatnonzero((np.diff(kind) != 0) | ((t[1:] % 2 == 1) & (kind[1:] > 0))) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(t)]):
            if not len(t) or kind[a] == 0:
                continue
            while a < b and text[a] in " \t\n\r":
                a += 1
            while b > a and text[b - 1] in " \t\n\r.,;":
                b -= 1
            if plausible(KINDS[kind[a] - 1], text[a:b]):
                out[i].append((KINDS[kind[a] - 1], a, b))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_spans and spans: one row per row of ``docs``, without a shuffle.

    The tagger's spans are added where no base span overlaps. Whole texts are read; offsets are code points, ends exclusive.
    A null or empty text has no spans (empty strings). Null ids and repeated rows are kept as they are. An empty table gives
    an empty result. The weights (about 60 KB, whatever the input) go to the tasks with the function.
    """
    model = tagger or trained(docs.sparkSession)

    def batch(ids: list, texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base_spans", "spans")}
        for t, more in zip(texts, tagged_spans(model, [t or "" for t in texts])):
            base = base_spans(t) if t else []
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            added = [x for x in more if not any(a < x[2] and x[1] < b for _, a, b in base)]
            out["base_spans"].append(spans_text(base, KINDS))
            out["spans"].append(spans_text(base + added, KINDS))
        return {"doc_id": ids} | out

    return map_rows(texts_of(docs, id_col, text_col), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string", batch)
