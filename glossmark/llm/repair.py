"""Re-Pair grammar compression of token ids (Larsson and Moffat, 2000), with the block format of a token shard.

A block: a header of 5 numbers, the rules (pairs of symbols), the expansion length of every rule, the place of every document in
the sequence, then the sequence. All numbers are little-endian unsigned 32-bit, the symbols of rules and sequence 16-bit where
they fit. Symbols up to ``end`` are token ids, ``end`` closes a document, larger ones are nonterminals in the order of their rules.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x52455031
#: Symbols up to this one are written with 16 bits, others with 32: a vocabulary of any size gets its rules.
MAX_SHORT = (1 << 16) - 1
#: A pair must occur so often to become a rule, and a round must shorten the sequence by this share to be followed by another.
#: Rounds to the last pair that repays its rule save 1 to 4 percent more and take 8 times the time.
MIN_COUNT, MIN_GAIN = 8, 0.01
#: Pairs that one round takes at most; the next round takes the others.
PAIRS_A_ROUND = 4096
_BUCKET_BITS = 20


def compress(seq: np.ndarray, end: int, min_count: int = MIN_COUNT, min_gain: float = MIN_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Rules (pairs) and the sequence left.

    Each round counts all neighbouring pairs in hash buckets, takes frequent ones, and replaces those occurrences that are more
    frequent than the pairs overlapping them; the others wait for the next round. No pair crosses ``end``, so every document
    stays a slice of the sequence.
    """
    seq, rules, symbol = seq.astype(np.uint32), [], end + 1
    n_buckets = 1 << _BUCKET_BITS
    for turn in range(64):
        if len(seq) < 2:
            break
        # Other factors each round, so that pairs that share a bucket part in the next.
        bucket = seq[:-1] * np.uint32(0x9E3779B1 + 2 * turn) + seq[1:] * np.uint32(0x85EBCA77 + 6 * turn)
        bucket >>= np.uint32(32 - _BUCKET_BITS)
        bucket = bucket.astype(np.int64)
        ends = np.flatnonzero(seq == end)
        bucket[ends[ends < len(bucket)]] = n_buckets
        bucket[ends[ends > 0] - 1] = n_buckets
        count = np.bincount(bucket, minlength=n_buckets + 1)
        count[n_buckets] = 0
        frequent = np.flatnonzero(count >= min_count)
        if len(frequent) > PAIRS_A_ROUND:
            frequent = frequent[np.argpartition(count[frequent], -PAIRS_A_ROUND)[-PAIRS_A_ROUND:]]
        chosen = np.zeros(n_buckets + 1, bool)
        chosen[frequent] = True
        at = np.flatnonzero(chosen[bucket])
        if not len(at):
            break
        # One pair stands for its bucket: the first seen. Occurrences of another pair in the bucket don't count.
        own, key = bucket[at], seq[at].astype(np.int64) << 32 | seq[at + 1]
        pair_of = np.zeros(n_buckets + 1, np.int64)
        pair_of[own[::-1]] = key[::-1]
        same = pair_of[own] == key
        at, own = at[same], own[same]
        exact = np.bincount(own, minlength=n_buckets + 1)
        w = exact[own].astype(np.int32)
        weight = np.zeros(len(seq) + 2, np.int32)
        weight[at + 1] = w
        keep = (w >= min_count) & (w > weight[at]) & (w >= weight[at + 2])
        at, own = at[keep], own[keep]
        used = np.bincount(own, minlength=n_buckets + 1)
        worth = used[own] >= 4  # a rule costs three numbers
        at, own = at[worth], own[worth]
        if not len(at):
            break
        new = np.flatnonzero(used >= 4)
        number = np.zeros(n_buckets + 1, np.uint32)
        number[new] = symbol + np.arange(len(new))
        rules.append(np.stack([pair_of[new] >> 32, pair_of[new] & ((1 << 32) - 1)], axis=1))
        symbol += len(new)
        seq[at] = number[own]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        gain = len(at) / len(seq)
        seq = seq[stay]
        if gain < min_gain:
            break
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)).astype(np.int32), seq.astype(np.int32)


def expansion_lengths(rules: np.ndarray, end: int) -> np.ndarray:
    """Token ids that each rule stands for. A rule only names earlier ones, so rounds over the rules reach every length."""
    lengths = np.zeros(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (1 if a <= end else lengths[a - end - 1]) + (1 if b <= end else lengths[b - end - 1])
    return lengths


def expand(seq: np.ndarray, rules: np.ndarray, end: int) -> np.ndarray:
    """The token ids (and ends) of a sequence; each pass opens one level of rules."""
    seq = seq.astype(np.int32)
    while True:
        is_rule = seq > end
        if not is_rule.any():
            return seq
        size = 1 + is_rule.astype(np.int64)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int32)
        pairs = rules[seq[is_rule] - end - 1]
        out[first[~is_rule]] = seq[~is_rule]
        out[first[is_rule]] = pairs[:, 0]
        out[first[is_rule] + 1] = pairs[:, 1]
        seq = out


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """As ``expand``, for a whole block: every rule is opened once, then each symbol copies its ids from there."""
    if lengths.sum() > 4 * len(seq) + (1 << 20):  # few very long rules: the passes need less memory
        return expand(seq, rules, end)
    # The ids of all rules one after the other, behind one place for each plain symbol.
    flat = np.concatenate([np.arange(end + 1, dtype=np.int32), expand(np.arange(end + 1, end + 1 + len(rules)), rules, end)])
    size = np.concatenate([np.ones(end + 1, np.int64), lengths.astype(np.int64)])
    source = np.cumsum(size) - size
    n = size[seq]
    return flat[np.arange(n.sum()) + np.repeat(source[seq] - (np.cumsum(n) - n), n)]


def pack(seq: np.ndarray, end: int) -> bytes:
    """A block of documents, each closed by ``end``."""
    rules, left = compress(seq, end)
    wide = end + len(rules) > MAX_SHORT
    kind = "<u4" if wide else "<u2"
    places = np.concatenate([[0], np.flatnonzero(left == end) + 1])
    head = np.array([MAGIC, end, len(rules), len(places) - 1, len(left) << 1 | wide], "<u4")
    return b"".join([head.tobytes(), rules.astype(kind).tobytes(), expansion_lengths(rules, end).astype("<u4").tobytes(), places.astype("<u4").tobytes(), left.astype(kind).tobytes()])


class Block:
    """A packed block, read back. ``document(k)`` decodes one document alone."""

    def __init__(self, data: bytes) -> None:
        magic, self.end, n_rules, self.n_docs, size = np.frombuffer(data, "<u4", 5).tolist()
        if magic != MAGIC:
            raise ValueError("not a token block")
        kind, width = ("<u4", 4) if size & 1 else ("<u2", 2)
        at = 20
        self.rules = np.frombuffer(data, kind, 2 * n_rules, at).astype(np.int32).reshape(-1, 2)
        at += 2 * n_rules * width
        self.lengths = np.frombuffer(data, "<u4", n_rules, at)
        at += 4 * n_rules
        self.places = np.frombuffer(data, "<u4", self.n_docs + 1, at).astype(np.int64)
        at += 4 * (self.n_docs + 1)
        self.seq = np.frombuffer(data, kind, size >> 1, at).astype(np.int32)

    def all(self) -> np.ndarray:
        return expand_all(self.seq, self.rules, self.lengths, self.end)

    def document(self, k: int) -> np.ndarray:
        return expand(self.seq[self.places[k] : self.places[k + 1]], self.rules, self.end)

    def token(self, k: int, offset: int) -> int:
        """Token ``offset`` of document ``k``: the expansion lengths lead to it without opening the symbols before it."""
        for symbol in self.seq[self.places[k] : self.places[k + 1]].tolist():
            size = 1 if symbol <= self.end else int(self.lengths[symbol - self.end - 1])
            if offset >= size:
                offset -= size
                continue
            while symbol > self.end:
                a, b = self.rules[symbol - self.end - 1].tolist()
                size = 1 if a <= self.end else int(self.lengths[a - self.end - 1])
                symbol, offset = (a, offset) if offset < size else (b, offset - size)
            return symbol
        raise IndexError(offset)
