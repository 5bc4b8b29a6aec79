"""Texts to token ids with the tokenizers library; pieces met before are taken from a fixed table of ids."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa

#: Places of the table of pieces, as a power of two.
SLOT_BITS = 19
#: Longest piece that the table holds in bytes, and most ids of a piece; others go to the library each time.
KEY_BYTES, ROW_IDS = 24, 8

# Classes of bytes: other ASCII, letter, digit, apostrophe, part of a character beyond ASCII, space, line break.
_OTHER, _LETTER, _DIGIT, _QUOTE, _WIDE, _SPACE, _BREAK = range(7)
_CLASS = np.array(
    [_BREAK if b == 10 else _SPACE if b == 32 else _QUOTE if b == 39 else _DIGIT if 48 <= b <= 57 else _LETTER if chr(b).isalpha() and b < 128 else _WIDE if b >= 128 else _OTHER for b in range(256)],
    np.uint8,
)


def _cut_table() -> np.ndarray:
    """Whether the byte-level pre-tokenizer surely cuts between two bytes, by their classes.

    It cuts before a single space and on both sides of a single line break between words, and where letters, digits and other
    characters meet. An apostrophe can belong to the letters behind it, and a byte beyond ASCII can be any kind.
    """
    kind = {_OTHER: 0, _LETTER: 1, _DIGIT: 2, _QUOTE: 0}
    cut = np.zeros((7, 7), bool)
    for a in range(7):
        for b in range(7):
            differ = a in kind and b in kind and kind[a] != kind[b] and (a, b) != (_QUOTE, _LETTER)
            cut[a, b] = differ or b in (_SPACE, _BREAK) or a == _BREAK
    return cut.ravel()


_CUT = _cut_table()
# The first n bytes of a little-endian number.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

# Surely one piece of the pre-tokenizer, so the library's model can take it alone.
_ONE = re.compile(" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F\u0401\u0410-\u044F\u0451]+|[0-9]+|[!-&(-/:-@\\[-`{-~]+)")
# The printable characters by which byte-level vocabularies name bytes: printable Latin-1 ones stand for themselves, the rest follow from 256.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def odd_places(data: np.ndarray) -> np.ndarray:
    """Places of white space that is not a single space or line break: pairs, control characters, white space beyond ASCII.

    A pair is reported at its second place.
    """
    gap = (data == 32) | (data == 10)
    found = [np.flatnonzero(gap[1:] & gap[:-1]) + 1, np.flatnonzero((data < 32) & (data != 10))]
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | (data == 0xEF))
    if len(at):
        more = np.concatenate([data, np.zeros(2, np.uint8)])
        a, b, c = more[at], more[at + 1], more[at + 2]
        odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8D) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd |= (a == 0xE2) & (b == 0x81) & ((c == 0x9F) | (c == 0xA0))
        odd |= ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
        found.append(at[odd])
    return np.concatenate(found)


class Encoder:
    """Ids of texts as unsigned 32-bit numbers, equal to the library's.

    Where the tokenizer's pre-tokenizer is the plain byte-level one, texts are cut into pieces at places where it cuts for sure.
    A piece's bytes are its key in a table of 2 ** ``SLOT_BITS`` places, compared in full; only pieces that are not there go to the
    library. A piece that was met again since keeps its place once against a new one. Texts with other white space than single
    spaces and line breaks, or with the string of an added token, go to the library whole, as all texts of other tokenizers do.
    """

    def __init__(self, path: str, slot_bits: int = SLOT_BITS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        pre = config.get("pre_tokenizer") or {}
        self.cuts = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not config.get("normalizer")
        self.cuts = self.cuts and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and not config.get("truncation") and not config.get("padding")
        self.added = [t["content"].encode() for t in config.get("added_tokens") or ()]
        self.shift = np.uint64(64 - slot_bits)
        # A row: the piece's bytes, the number of its ids, the ids.
        self.kind = np.dtype(np.uint16 if self.n_ids <= 1 << 16 else np.uint32)
        self.table = np.zeros((1 << slot_bits, KEY_BYTES // 8 + 1 + ROW_IDS * self.kind.itemsize // 8), np.uint64)
        self.used = np.zeros(1 << slot_bits, bool)
        if self.cuts:
            # Alone, they could not be told from the separator of new pieces, or would run together with it.
            self.fixed = {x: self._library([x.decode()])[0].tolist() for x in (b"\n", b" ")}
            self.break_id = self.fixed[b"\n"][0]
            self.cuts = len(self.fixed[b"\n"]) == 1

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces. Single ones go to the library's model, the others to its pre-tokenizer too, as lines of one text."""
        out: list = [self.fixed.get(p) for p in pieces]
        lines, tokenize = [], self.tokenizer.model.tokenize
        for i, p in enumerate(pieces):
            if out[i] is None:
                if _ONE.fullmatch(p.decode()):
                    out[i] = [t.id for t in tokenize(p.decode("latin-1").translate(_NAMES))]
                else:
                    lines.append(i)
        for at in range(0, len(lines), 2000):
            part = lines[at : at + 2000]
            # No piece holds a line break, so its id parts them again.
            ids = self._library(["\n".join([pieces[i].decode() for i in part])])[0]
            ends = np.flatnonzero(ids == self.break_id)
            for i, a, b in zip(part, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b].tolist()
        return out

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts one after the other, and where each text begins among them."""
        n = len(data)
        begins = np.zeros(n, bool)
        kinds = _CLASS[data]
        begins[1:] = _CUT[kinds[:-1] * np.uint8(7) + kinds[1:]]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(begins)
        length = np.diff(at, append=n)
        buffer = np.zeros(n + KEY_BYTES, np.uint8)
        buffer[:n] = data
        words = np.ndarray((n + KEY_BYTES - 7,), "<u8", buffer, strides=(1,))
        key = [words[at + 8 * i] & _MASK[np.clip(length - 8 * i, 0, 8)] for i in range(3)]
        h = key[0] * _MIX[0]
        for k, m in zip(key[1:], _MIX[1:]):
            h = (h ^ (h >> np.uint64(29)) ^ k) * m
        slot = ((h ^ (h >> np.uint64(32))) * _MIX[0] >> self.shift).astype(np.int64)
        found = self.table.take(slot, axis=0)
        hit = (length <= KEY_BYTES) & (found[:, 0] == key[0]) & (found[:, 1] == key[1]) & (found[:, 2] == key[2])
        self.used[slot[hit]] = True
        size = found[:, 3].astype(np.int64)
        rows = np.ascontiguousarray(found[:, 4:]).view(self.kind)
        miss = np.flatnonzero(~hit)
        longer: dict[int, list[int]] = {}
        if len(miss):
            # Equal pieces are asked for once.
            number: dict[bytes, int] = {}
            raw = data.tobytes()
            which = np.array([number.setdefault(raw[a : a + k], len(number)) for a, k in zip(at[miss].tolist(), length[miss].tolist())])
            ids = self._new(list(number))
            n_ids = np.array([len(x) for x in ids])
            values = np.zeros((len(ids), ROW_IDS), self.kind)
            values[np.arange(ROW_IDS) < n_ids[:, None]] = [k for x in ids for k in x[:ROW_IDS]]
            size[miss], rows[miss] = n_ids[which], values[which]
            longer = {i: ids[w] for i, w in zip(miss.tolist(), which.tolist()) if n_ids[w] > ROW_IDS}
            fits = miss[(length[miss] <= KEY_BYTES) & (size[miss] <= ROW_IDS)]
            free = ~self.used[slot[fits]]
            self.used[slot[fits]] = False
            fits = fits[free]
            new = np.empty((len(fits), self.table.shape[1]), np.uint64)
            for i in range(3):
                new[:, i] = key[i][fits]
            new[:, 3], new[:, 4:] = size[fits], np.ascontiguousarray(rows[fits]).view(np.uint64)
            place, first = np.unique(slot[fits], return_index=True)  # of two new pieces of one place, one stays
            self.table[place] = new[first]
        ends = np.cumsum(size)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        regular = size <= ROW_IDS
        if longer:
            flat[np.repeat(regular, size)] = rows[regular][np.arange(ROW_IDS) < size[regular][:, None]]
            for i, x in longer.items():
                flat[ends[i] - size[i] : ends[i]] = x
        else:
            flat[:] = rows[np.arange(ROW_IDS) < size[:, None]]
        return flat, np.concatenate([[0], ends])[np.searchsorted(at, offsets)]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow string column; a null text has none."""
        texts = texts.cast(pa.large_string())
        if not self.cuts:
            return self._library([t or "" for t in texts.to_pylist()])
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        places = odd_places(data)
        places = places[~np.isin(places, offsets) | (data[places] != 32) & (data[places] != 10)]  # no pair across two texts
        raw = data.tobytes()
        more = []
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                more.append(i)
                i = raw.find(token, i + 1)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.concatenate([places, np.array(more, np.int64)]), side="right") - 1] = True
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain = np.flatnonzero(~odd & (np.diff(offsets) > 0))
        if odd.any():
            for i, ids in zip(np.flatnonzero(odd).tolist(), self._library([texts[i].as_py() for i in np.flatnonzero(odd).tolist()])):
                out[i] = ids
            size = np.diff(offsets)[plain]
            data = data[np.repeat(~odd, np.diff(offsets))]
            offsets = np.concatenate([[0], np.cumsum(size)])
        else:
            offsets = np.append(offsets[plain], offsets[-1])
        if len(plain):
            flat, cut = self._pieces(data, offsets)
            for i, a, b in zip(plain.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                out[i] = flat[a:b]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encode_column(pa.array(texts, pa.large_string()))]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The worker's encoder. It and its table stay for later tasks; both are of fixed size."""
    return Encoder(path)
