"""N-gram Jaccard join: universe-partition pigeonhole with one-deletion neighbourhoods, then exact verification.

Two sets of at most U elements with a Jaccard similarity of p percent or more differ in at most H = (100 - p) / (100 + p) * 2 U
elements. Hashing the universe into H + 1 segments, at least one segment of the two is equal (Arasu et al., 2006). A document
whose cost is too high in a segment (an empty one equals the empty ones of all others) skips it and instead allows one differing
element in the cheapest other segment, whose one-deletion neighbourhood is indexed (Deng et al., 2015).

Index rows travel packed: one row of a task's output holds all hashes of a range, some 8 bytes each with their documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmark.llm.common import arrow_batches, give_back_memory, materialize, release, texts_of
from glossmark.llm.components import components
from glossmark.llm.shingles import MIX, mix, shingle_sets

#: Each size band reaches to so many times its least size.
BAND_RATIO = 1.3
#: Rows (of some 40 bytes) up to which a side of a join is broadcast; beyond, it is shuffled. The driver holds a broadcast several
#: times over while it makes it (rows, table, blocks), and two at once where both ends of pairs are joined, so the limits are low.
BROADCAST_IDS = 200_000
#: Bytes of all sketches up to which they are broadcast; beyond, pairs and members are shuffled to them.
BROADCAST_SKETCHES = 8 << 20
#: Nodes in a block of a bucket: two blocks are compared in one step of a task.
BLOCK_NODES = 256
#: Nearest partners that a node of a group asks in the first rounds; what these link needs no further pairs, the last round asks all.
NEAREST = (4, 64)
#: Of a node's open groups, so many (the least ones) go with it, so that a pair is made only in the least group that both have. More
#: of them would only find more repetitions; the pair is made in any case.
KNOWN_GROUPS = 16
#: Index rows that a task packs at once, and those that a task of the next step shall receive.
PACK_ROWS, BUCKET_ROWS = 300_000, 1_500_000
#: Documents with one hash in one pack from which on they are linked there, and only the least and the greatest go to the hash's range.
HEAVY = 64

# Roles of an index row: it can be found, it looks for others, or both. A heavy one stands for others that are linked to it.
FOUND, LOOKS, BOTH, STANDS = 1, 2, 3, 4
_ROLE = np.uint64(7)
_LOW_BITS = 40
_LOW = np.uint64((1 << _LOW_BITS) - 1)


@dataclass(frozen=True)
class Segments:
    """The partition of the universe for a similarity of ``percent`` or more."""

    percent: int = 90

    @cached_property
    def edges(self) -> np.ndarray:
        """First sizes of the bands. A band reaches beyond the partners of the band before it, so partners are one apart at most."""
        out = [1]
        while out[-1] < 1 << 31:
            out.append(max(out[-1] * 100 // self.percent + 1, int(out[-1] * BAND_RATIO)))
        return np.array(out, np.int64)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def bands(self, size: int) -> list[int]:
        """The own band, and the next one if a larger partner can be there."""
        a, b = self.band(size), self.band(size * 100 // self.percent)
        return [a] if a == b else [a, b]

    def difference(self, band: int) -> int:
        """The most elements in which linked sets of a band differ."""
        return (100 - self.percent) * 2 * (int(self.edges[band + 1]) - 1) // (100 + self.percent)

    @lru_cache(maxsize=256)  # noqa: B019  one object for each percent, kept for good
    def promoted(self, band: int) -> int:
        """So many segments, the first ones, can be searched with one deletion: as many as a small set of the band has empty ones, and some.

        Each costs an index row for each of its elements; each empty segment beyond them is a bucket with all others that have it.
        """
        n = self.difference(band) + 1
        empty = n * math.exp(-0.8 * float(self.edges[band]) / n)
        return min(n, 1 + math.ceil(empty + 4 * math.sqrt(empty)))

    @property
    def rows_per_element(self) -> float:
        """Index rows of a set for each of its elements, about: segments of its bands and deletions."""
        return 7 * (100 - self.percent) / (100 + self.percent)

    def signatures(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index rows of a set: hashes, and their roles."""
        keys, roles = [], []
        for band in self.bands(len(shingles)) if len(shingles) else ():
            if (h := self.difference(band)) == 0:
                continue  # only equal sets are linked
            k, r = self._band_rows(shingles, band, h + 1)
            keys += k
            roles += [np.full(len(x), role, np.int8) for x, role in zip(k, r)]
        return (np.concatenate(keys), np.concatenate(roles)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int8))

    def _band_rows(self, shingles: np.ndarray, band: int, m: int) -> tuple[list, list]:
        place = ((shingles >> np.uint64(17)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, parts = place[order], mix(shingles[order] + np.uint64((band + 1) * 0x3C6EF372FE94F82A % 2**64))
        sizes = np.bincount(place, minlength=m)
        used = np.flatnonzero(sizes)
        sums = np.zeros(m, np.uint64)
        sums[used] = np.add.reduceat(parts, (np.cumsum(sizes) - sizes)[used])
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 33))
        exact = lambda at, s: mix(s + salt[at])
        deleted = lambda at, s: mix((s + salt[at]) ^ MIX)
        # Cost by size of the segment: an empty one would meet every other empty one, so it is skipped, and the smallest full ones
        # of the promoted segments allow one difference instead. What is left over keeps searching its empty segments. A set without
        # empty ones differs from the others in every segment that they skip, so it needs none of this.
        empty = np.flatnonzero(sizes == 0)
        keys, roles = [exact(used, sums[used])], [BOTH]
        if len(empty):
            listed = np.arange(self.promoted(band))
            whole = sums[place]
            near = (place < len(listed)) & (sizes[place] >= 2)  # a deletion that leaves nothing says nothing
            keys.append(deleted(place[near], whole[near] - parts[near]))
            roles.append(FOUND)
            can = listed[sizes[listed] >= 2]
            can = can[np.argsort(sizes[can], kind="stable")][: len(empty)]
            skipped, kept = empty[: len(can)], empty[len(can) :]
            search = np.isin(place, can)
            keys += [exact(kept, sums[kept]), exact(skipped, sums[skipped]), exact(place[search], whole[search] - parts[search]), deleted(can, sums[can])]
            roles += [BOTH, FOUND, LOOKS, LOOKS]
        return keys, roles

    def sketch(self, shingles: np.ndarray) -> bytes:
        """Parity bits of the hashed elements. Two sets differ in at least as many elements as their sketches in bits."""
        if not len(shingles):
            return b""
        bits = 1 << max(8, int(4 * self.difference(self.band(len(shingles)))).bit_length())
        odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def may_link(self, a: np.ndarray, b: np.ndarray, x: pa.Array, y: pa.Array) -> np.ndarray:
        """False only for pairs that sizes (a, b) or sketches (binary columns x, y) rule out."""
        out = 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)
        (p, n), (q, k) = _bytes_of(x), _bytes_of(y)
        most = (100 - self.percent) * (a + b) // (100 + self.percent)
        widths = n.astype(np.int64) << 32 | k
        for w in np.unique(widths[out]).tolist():
            at = np.flatnonzero(out & (widths == w))
            for some in np.array_split(at, 1 + len(at) * ((w >> 32) + (w & 0xFFFFFFFF)) // (8 << 20)):
                left, right = (self._words(data, start[some], size) for data, start, size in ((x, p, w >> 32), (y, q, w & 0xFFFFFFFF)))
                # A longer sketch folds onto a shorter one.
                width = min(left.shape[1], right.shape[1])
                left, right = (np.bitwise_xor.reduce(z.reshape(len(some), -1, width), axis=1) for z in (left, right))
                out[some] = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64) <= most[some]
        return out

    @staticmethod
    def _words(column: pa.Array, start: np.ndarray, size: int) -> np.ndarray:
        data = np.frombuffer(column.buffers()[2], np.uint8)
        return data[start[:, None] + np.arange(size)].view(np.uint64)

    def linked_pairs(self, x: pa.Array, y: pa.Array) -> np.ndarray:
        """Whether the sets (binary columns of sorted 64-bit hashes) are linked."""
        return np.array([self.linked(p.as_buffer(), q.as_buffer()) for p, q in zip(x, y)], bool)

    def linked(self, x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([p, q])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return 100 * shared >= self.percent * (len(p) + len(q) - shared)

    def likely_of(self, group: int, main: int, out: pa.StructArray, every: pa.StructArray, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pairs of ``out`` with ``every`` (``_BLOCK`` records of one group) that may link two components and that no lesser group has.

        Each node asks its ``most`` nearest partners; the last value tells whether any had more.
        """
        (a, ra, na), (b, rb, nb) = ([x.field(k).to_numpy() for k in range(3)] for x in (out, every))
        # Two nodes outside the main component meet twice; the smaller one asks.
        open_ = (ra[:, None] != rb[None, :]) & ((rb == main)[None, :] | (a[:, None] < b[None, :]))
        open_ &= 100 * np.minimum(na[:, None], nb[None, :]) >= self.percent * np.maximum(na[:, None], nb[None, :])
        i, j = np.nonzero(open_)
        xa, xb = self._folded(out.field(3), every.field(3))
        apart = np.zeros(len(i), np.int64)
        for w in range(xa.shape[1]):
            apart += np.bitwise_count(xa[i, w] ^ xb[j, w])
        yes = apart <= (100 - self.percent) * (na[i] + nb[j]) // (100 + self.percent)
        i, j, apart = i[yes], j[yes], apart[yes]
        ga, gb = _lesser_groups(group, out.field(4), every.field(4))
        own = np.ones(len(i), bool)
        for w in range(ga.shape[1]):
            own &= ga[i, w] & gb[j, w] == 0
        i, j, apart = i[own], j[own], apart[own]
        order = np.lexsort((b[j], apart, i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)  # how many nearer partners the node has
        near = place < most
        i, j = i[near], j[near]
        return np.minimum(a[i], b[j]), np.maximum(a[i], b[j]), not near.all()

    def _folded(self, *columns: pa.Array) -> list[np.ndarray]:
        """Sketches of binary columns as rows of words, all folded onto the shortest."""
        width = min(int(_bytes_of(c)[1].min()) for c in columns) // 8
        out = []
        for c in columns:
            start, size = _bytes_of(c)
            bits = np.zeros((len(c), width), np.uint64)
            for w in np.unique(size).tolist():
                at = np.flatnonzero(size == w)
                bits[at] = np.bitwise_xor.reduce(self._words(c, start[at], w).reshape(len(at), -1, width), axis=1)
            out.append(bits)
        return out


def _lesser_groups(group: int, *columns: pa.ListArray) -> list[np.ndarray]:
    """For lists of groups: a row of bits each, one for every group before ``group``. Rows with a common bit meet there too."""
    flat = [c.flatten().to_numpy() for c in columns]
    known = np.unique(np.concatenate([x[x < group] for x in flat]))
    out = []
    for c, x in zip(columns, flat):
        row = np.repeat(np.arange(len(c)), np.diff(c.offsets.to_numpy()))[x < group]
        at = np.searchsorted(known, x[x < group])
        bits = np.zeros((len(c), -(-len(known) // 64)), np.uint64)
        np.bitwise_or.at(bits, (row, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        out.append(bits)
    return out


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the data buffer and sizes of the values of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    return offsets[:-1], np.diff(offsets)


@lru_cache(maxsize=8)
def segments(percent: int) -> Segments:
    return Segments(percent)


def digests(shingles: np.ndarray) -> tuple[int | None, int | None]:
    """Two 64-bit halves of a digest of a set; the empty set has none."""
    if not len(shingles):
        return None, None
    d = blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def node_of(shingles: np.ndarray, taken: frozenset = frozenset()) -> int | None:
    """Equal sets are one node: the first half of their digest, or the second where different sets share the first."""
    a, b = digests(shingles)
    return b if a in taken else a


def _arrow(df: DataFrame, fields: list, rows: object) -> DataFrame:
    """``mapInArrow`` of ``rows(columns) -> output columns``."""
    want = pa.schema(fields)
    names = {pa.int64(): "long", pa.binary(): "binary", pa.int32(): "int"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                out = rows(*b.slice(at, 200).columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(out, want)], schema=want)
        give_back_memory()

    return df.mapInArrow(run, ", ".join(f"{n} {names[k]}" for n, k in fields))


def document_sets(texts: DataFrame, n_words: int, percent: int) -> DataFrame:
    """doc_id, row_key, n_shingles, node, check, sketch of every row of ``texts`` (doc_id, text, row_key)."""
    fields = [("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary())]

    def rows(ids: pa.Array, found: pa.Array, keys: pa.Array) -> list:
        sets, seg = shingle_sets(found, n_words), segments(percent)
        halves = [digests(s) for s in sets]
        return [ids, keys, [len(s) for s in sets], [a for a, _ in halves], [b for _, b in halves], [seg.sketch(s) for s in sets]]

    return _arrow(texts, fields, rows)


class _Packer:
    """Gathers index rows of a task and packs them by ranges of their hashes."""

    def __init__(self, n_buckets: int) -> None:
        self.n_buckets, self.turn = n_buckets, 0
        self.keys: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.held = 0

    def add(self, keys: np.ndarray, roles: np.ndarray, node: int) -> bool:
        self.keys.append(keys & ~_ROLE | roles.astype(np.uint64))
        self.nodes.append(node)
        self.held += len(keys)
        return self.held >= PACK_ROWS

    def packed(self) -> tuple[list, list, list, list]:
        """Buckets, names of heavy hashes, hashes, nodes. Heavy ones are rows of their own, in any bucket."""
        sig = np.concatenate([*self.keys, np.zeros(0, np.uint64)])
        node = np.repeat(np.array(self.nodes, np.int64), [len(k) for k in self.keys])
        self.keys, self.nodes, self.held = [], [], 0
        # Buckets are ranges of the hashes; in a bucket, 40 bits tell them and their roles apart. Others that fall together are only
        # checked in vain.
        sig = (sig >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32) << np.uint64(_LOW_BITS) | sig & _LOW
        order = np.argsort(sig)
        sig, node = sig[order], node[order]
        bare = sig & ~_ROLE
        begins = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]])) if len(sig) else np.zeros(0, np.int64)
        sizes = np.diff(begins, append=len(sig))
        buckets, names, hashes, nodes = [], [], [], []
        heavy = np.flatnonzero(sizes >= HEAVY)
        if len(heavy):
            stay = np.ones(len(sig), bool)
            more: list[tuple[int, int]] = []
            for a, n in zip(begins[heavy].tolist(), sizes[heavy].tolist()):
                own = np.unique(node[a : a + n])
                role = int(np.bitwise_or.reduce(sig[a : a + n] & _ROLE)) | STANDS
                stay[a : a + n] = False
                more += [(int(bare[a]) | role, int(own[0])), (int(bare[a]) | role, int(own[-1]))]
                self.turn += 1
                buckets.append(((int(bare[a]) >> 7) + self.turn) % self.n_buckets)
                names.append(int(bare[a : a + 1].view(np.int64)[0]))
                hashes.append(b"")
                nodes.append(own.tobytes())
            sig = np.concatenate([sig[stay], np.array([s for s, _ in more], np.uint64)])
            node = np.concatenate([node[stay], np.array([x for _, x in more], np.int64)])
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
        place = (sig >> np.uint64(_LOW_BITS)).astype(np.int64)
        there, first = np.unique(place, return_index=True)
        low = sig.view(np.uint8).reshape(-1, 8)[:, : _LOW_BITS // 8]
        for b, x, y in zip(there.tolist(), first.tolist(), [*first[1:].tolist(), len(sig)]):
            buckets.append(b)
            names.append(None)
            hashes.append(low[x:y].tobytes())
            nodes.append(pack_nodes(node[x:y]))
        return buckets, names, hashes, nodes


def pack_nodes(nodes: np.ndarray) -> bytes:
    """The distinct nodes, and which of them each is."""
    own, which = np.unique(nodes, return_inverse=True)
    kind = np.uint16 if len(own) <= 1 << 16 else np.uint32
    return b"".join([np.array([len(own)], np.uint32).tobytes(), own.tobytes(), which.astype(kind).tobytes()])


def unpack(bucket: int, hashes: memoryview, nodes: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with their bucket and roles, and nodes, as ``_Packer`` packed them."""
    low = np.frombuffer(hashes, np.uint8).reshape(-1, _LOW_BITS // 8)
    sig = np.zeros((len(low), 8), np.uint8)
    sig[:, : _LOW_BITS // 8] = low
    n = int(np.frombuffer(nodes, np.uint32, 1)[0])
    own = np.frombuffer(nodes, np.int64, n, 4)
    which = np.frombuffer(nodes, np.uint16 if n <= 1 << 16 else np.uint32, len(low), 4 + 8 * n)
    return sig.reshape(-1).view(np.uint64) | np.uint64(bucket) << np.uint64(_LOW_BITS), own[which]


def index_packs(texts: DataFrame, n_words: int, percent: int, n_buckets: int, taken: frozenset) -> DataFrame:
    """bucket, name, sigs, nodes: the index rows of all texts, packed. A task leaves out a set that it has just had."""
    want = pa.schema([("bucket", pa.int32()), ("name", pa.int64()), ("sigs", pa.binary()), ("nodes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, packer, seen = segments(percent), _Packer(n_buckets), set()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(packer.packed(), want)], schema=want)

        for b in batches:
            for at in range(0, b.num_rows, 200):
                for s in shingle_sets(b.column(1).slice(at, 200), n_words):
                    node = node_of(s, taken)
                    if node is None or node in seen:
                        continue
                    if len(seen) >= 100_000:  # repeated rows are only more work for the next step
                        seen.clear()
                    seen.add(node)
                    if packer.add(*seg.signatures(s), node):
                        yield batch()
        yield batch()
        seen.clear()
        give_back_memory()

    return texts.mapInArrow(run, "bucket int, name long, sigs binary, nodes binary")


def _bucket_links(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all index rows of some ranges: pairs of nodes to check (a, b), and what is left to look at later (group, node).

    In every bucket each node is paired with the least and the greatest one. The other nodes of a bucket of four or more are left,
    and all that stand for others. Buckets with the same nodes are one group.
    """
    none = np.zeros(0, np.int64)
    bare = sig & ~_ROLE
    order = np.argsort(bare)
    bare = bare[order]
    more = np.zeros(len(bare), bool)
    more[1:] = bare[1:] == bare[:-1]
    more[:-1] |= more[1:]
    order, bare = order[more], bare[more]
    if not len(order):
        return none, none, none, none
    node, role = node[order], (sig[order] & _ROLE).astype(np.int64)
    order = np.lexsort((node, bare))
    bare, node, role = bare[order], node[order], role[order]
    begins = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
    roles = np.bitwise_or.reduceat(role, begins)
    first = np.concatenate([[True], (bare[1:] != bare[:-1]) | (node[1:] != node[:-1])])
    sizes = np.add.reduceat(first.astype(np.int64), begins)
    good = (((roles & BOTH) == BOTH) & (sizes >= 2)) | ((roles & STANDS) > 0)
    group = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(bare)))
    keep = first & good[group]
    node, group = node[keep], group[keep]
    if not len(node):
        return none, none, none, none
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(begins, append=len(group))
    number = np.repeat(np.arange(len(begins)), sizes)
    low, high = node[begins][number], node[begins + sizes - 1][number]
    a, b = np.concatenate([low, node]), np.concatenate([node, high])
    a, b = a[(x := a != b)], b[x]
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    # A group's name is its nodes, or its hash where others stand behind it.
    stands = (roles[group[begins]] & STANDS) > 0
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), begins) + sizes.astype(np.uint64))
    name[stands] = bare[keep][begins][stands]
    chosen = np.zeros(len(begins), bool)
    chosen[np.unique(name, return_index=True)[1]] = True
    left = (chosen & (sizes >= 4) | stands)[number] & (stands[number] | (node != low) & (node != high))
    return pairs[:, 0], pairs[:, 1], name[number[left]].view(np.int64), node[left]


def met_nodes(packs: DataFrame, n_buckets: int) -> DataFrame:
    """kind, x, y: pairs of nodes to check (kind 0), groups and their nodes to look at later (kind 1)."""
    want = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])

    def rows(kind: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(x), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x[part]), kind, np.int32)), pa.array(x[part]), pa.array(y[part])], schema=want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in batches:
            for bucket, name, s, n in zip(*b.columns):
                if not name.is_valid:
                    sig, node = unpack(bucket.as_py(), s.as_buffer(), n.as_buffer())
                    sigs.append(sig)
                    nodes.append(node)
                    continue
                # Nodes of one heavy hash, sorted.
                node = np.frombuffer(n.as_buffer(), np.int64)
                yield from rows(0, np.full(len(node) - 1, node[0]), node[1:])
                yield from rows(0, node[1:-1], np.full(max(0, len(node) - 2), node[-1]))
                yield from rows(1, np.full(len(node), name.as_py()), node)
        a, b, group, node = _bucket_links(np.concatenate(sigs), np.concatenate(nodes))
        del sigs, nodes
        yield from rows(0, a, b)
        yield from rows(1, group, node)
        give_back_memory()

    return packs.repartitionById(n_buckets, F.col("bucket")).mapInArrow(run, "kind int, x long, y long")


def _kept(df: DataFrame, percent: int, method: str) -> DataFrame:
    """Pairs (a, b) of a table (a, b, and what ``method`` of the segments takes) for which it is true."""

    def rows(a: pa.Array, b: pa.Array, *given: pa.Array) -> list:
        yes = pa.array(getattr(segments(percent), method)(*(x.to_numpy() if x.type == pa.int64() else x for x in given)))
        return [a.filter(yes), b.filter(yes)]

    return _arrow(df, [("a", pa.int64()), ("b", pa.int64())], rows)


def _with_ends(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the columns of both ends, as ``c_a``, ``c_b``."""
    for end in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in columns)), end)
    return pairs.select("a", "b", *(f"{c}_{end}" for c in columns for end in "ab"))


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that sizes and sketches don't rule out."""
    return _kept(_with_ends(pairs, nodes, ["n_shingles", "sketch"]), percent, "may_link")


def sketches(nodes: DataFrame) -> DataFrame:
    """node, n_shingles, sketch of all nodes, to be broadcast if they are small."""
    table = nodes.select("node", "n_shingles", "sketch")
    size = table.agg(F.coalesce(F.sum(F.octet_length("sketch") + 64), F.lit(0))).head()[0]
    return F.broadcast(table) if size <= BROADCAST_SKETCHES else table


def small(table: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast if they are few; else hashed by partitions, so that the other side isn't sorted."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS else table.hint("shuffle_hash")


_BLOCK = ["node", "root", "n_shingles", "sketch", "groups"]


def _blocks(rows: DataFrame, blocks: str, name: str) -> DataFrame:
    """Rows of each group in about ``blocks`` lists of about ``BLOCK_NODES``."""
    place = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    return rows.groupBy("group", "main", place.alias(f"{name}_at")).agg(F.collect_list(F.struct(*_BLOCK)).alias(name))


def likely_in_blocks(open_: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a group and that sizes and sketches don't rule out; ``group`` if it has others.

    ``open_``: group, node, root, main (the group's largest component), all_blocks, outside_blocks. Blocks of nodes outside the
    main component meet blocks of all nodes. A task compares two blocks at once, so no row is made for a pair that is ruled out or
    that meets in a lesser group, and each node asks its ``most`` nearest partners of a block.
    """
    own = F.struct("group", "main", "all_blocks", "outside_blocks")
    by_node = open_.groupBy("node", "root").agg(F.sort_array(F.collect_list(own)).alias("of")).join(nodes, "node")
    rows = by_node.select(*_BLOCK[:-1], F.slice("of.group", 1, KNOWN_GROUPS).alias("groups"), F.inline("of"))
    # Most groups are one block, which meets itself.
    alone = _blocks(rows.filter("all_blocks = 1"), "all_blocks", "all").select("group", "main", F.filter("all", lambda x: x["root"] != F.col("main")).alias("out"), "all")
    rows, open_ = rows.filter("all_blocks > 1"), open_.filter("all_blocks > 1")
    every = _blocks(rows, "all_blocks", "all")
    outside = _blocks(rows.filter("root <> main"), "outside_blocks", "out")
    sizes = open_.select("group", "all_blocks").distinct()
    asked = outside.join(sizes, "group").withColumn("all_at", F.explode(F.sequence(F.lit(0), (F.col("all_blocks") - 1).cast("int"))))
    met = asked.join(every.drop("main"), ["group", "all_at"]).select("group", "main", "out", "all")
    want = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("group", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segments(percent)
        for batch in batches:
            for group, main, out, every_ in zip(*(batch.column(i) for i in range(4))):
                a, b, more = seg.likely_of(group.as_py(), main.as_py(), out.values, every_.values, most)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.repeat(group if more else pa.scalar(None, pa.int64()), len(a))], schema=want)

    return alone.unionByName(met).mapInArrow(run, "a long, b long, group long")


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n_words: int, percent: int, taken: frozenset) -> DataFrame:
    """The linked ones of likely pairs, by their whole sets, which are made anew from the texts."""
    spark = pairs.sparkSession
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(ends, "node", "left_semi").select("row_key", "node"), "wanted")
    chosen = texts.join(small(wanted.select("row_key")), "row_key", "left_semi").select("doc_id", "text")

    def rows(_: pa.Array, found: pa.Array) -> list:
        sets = shingle_sets(found, n_words)
        return [[node_of(s, taken) for s in sets], [s.tobytes() for s in sets]]

    made = _arrow(chosen, [("node", pa.int64()), ("shingles", pa.binary())], rows)
    sets = materialize(made.join(small(wanted.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
    with arrow_batches(spark, 200):
        return materialize(_kept(_with_ends(pairs, sets, ["shingles"]), percent, "linked_pairs"), "links")


def classes_of(docs: DataFrame, n_words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n_shingles, node) and, for nodes that are linked with others, node and root.

    1. Equal sets become one node. 2. Index rows are packed and dealt by ranges of their hashes; a hash that many sets of one pack
    share is linked there, and only two of them go on. 3. In every bucket each node is checked against the least and greatest one;
    the links make components. 4. Where the others of a bucket still are in several components, those outside the largest are
    checked against all of other components, block by block; first each against its nearest ones, as most are linked after that; only
    groups in which a node has others go on to the next round.
    So every candidate pair is either inside one component or checked, and a group of copies gives rows in proportion to its size.
    Sets are compared by 64-bit hashes of their shingles; sets with one 64-bit digest are told apart by 64 bits more.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col).withColumn("row_key", F.xxhash64("doc_id", "text"))
    rows = materialize(document_sets(texts, n_words, percent), "jaccard-rows")
    seg = segments(percent)

    def nodes_of(rows: DataFrame) -> DataFrame:
        x = F.min(F.struct("row_key", "n_shingles", "sketch")).alias("x")
        grouped = rows.filter("node is not null").groupBy("node").agg(x, (F.min("check") != F.max("check")).alias("shared"))
        return materialize(grouped.select("node", "shared", "x.*"), "nodes")

    nodes = nodes_of(rows)
    # Different sets with equal halves of a digest: about one in 10^19 pairs, so few at any size.
    taken = frozenset(r.node for r in nodes.filter("shared").select("node").toLocalIterator())
    if taken:
        rows = rows.withColumn("node", F.when(F.col("node").isin(*taken), F.col("check")).otherwise(F.col("node")))
        nodes = nodes_of(rows)
    elements = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(elements * seg.rows_per_element / BUCKET_ROWS))
    with arrow_batches(spark, 50):  # packs, and whole texts before them
        met = materialize(met_nodes(index_packs(texts.select("doc_id", "text"), n_words, percent, n_buckets, taken), n_buckets), "met")
    release(spark)  # the packs
    compact = sketches(nodes)
    stars = met.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    with arrow_batches(spark, 1000):
        stars = materialize(likely(stars, compact, percent), "likely")
    first = confirmed(stars, nodes, texts, n_words, percent, taken)
    members = materialize(met.filter("kind = 1").select(F.col("x").alias("group"), F.col("y").alias("node")).distinct(), "members")
    roots, checked = materialize(components(first), "roots"), stars
    open_ = _open_groups(members, roots)
    for most in (*NEAREST, 1 << 62):
        if open_ is None:
            break
        with arrow_batches(spark, 16):  # rows of two blocks
            found = materialize(likely_in_blocks(open_, compact, percent, most), "likely")
        pairs = materialize(found.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti"), "likely")
        links = confirmed(pairs, nodes, texts, n_words, percent, taken)
        grown = links.head(1)
        if grown:
            known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = materialize(components(known.unionByName(links)), "roots")
        # A group whose nodes had no partners beyond the nearest ones is done.
        more = materialize(found.filter("group is not null").select("group").distinct(), "unfinished")
        if not more.head(1):
            break
        members = materialize(members.join(small(more), "group", "left_semi"), "members")
        open_ = _open_groups(members, roots)
        checked = checked.unionByName(pairs)
    return rows.select("doc_id", "row_key", "n_shingles", "node"), roots


def _open_groups(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Members of the groups that lie in several components, with what ``likely_in_blocks`` takes; None if there are none."""
    placed = materialize(members.join(small(roots), "node", "left").select("group", "node", F.coalesce("root", "node").alias("root")), "placed")
    counts = placed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main"), F.count(F.lit(1)).alias("n_roots"))
    n_blocks = lambda n: F.ceil(n / BLOCK_NODES).cast("long")
    largest = largest.filter("n_roots > 1").select("group", "main", n_blocks(F.col("n")).alias("all_blocks"), n_blocks(F.col("n") - F.col("n_main")).alias("outside_blocks"))
    largest = materialize(largest, "largest")
    return materialize(placed.join(small(largest), "group"), "open") if largest.head(1) else None


def best_of_component(nodes: DataFrame, roots: DataFrame, value: str) -> DataFrame:
    """node and the least ``value`` (a column of ``nodes``) of its component. Most nodes are alone, so only linked ones are grouped."""
    linked = nodes.join(small(roots), "node").select("node", "root", value)
    least = materialize(linked.groupBy("root").agg(F.min(value).alias("__least")), "least")
    known = linked.join(small(least), "root").select("node", "__least")
    return nodes.join(known, "node", "left").select("node", F.coalesce("__least", value).alias(value))


def similar_documents(docs: DataFrame, n_words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs``.

    Documents are linked whose sets of ``n_words``-word shingles have a Jaccard similarity of ``percent`` / 100 or more;
    ``component_id`` is the smallest id reachable by links. Texts with fewer words are one shingle. A null, empty or wordless text
    has no shingles and is linked with nothing: its component is its own id. A null id counts as no id: a component takes the
    smallest id that is there, and is null if there is none. Repeated rows each get a row. An empty table gives no rows.
    """
    rows, roots = classes_of(docs, n_words, percent, id_col, text_col)
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(best_of_component(nodes, roots, "component_id"), "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id; own columns kept.

    A group's rows are its rows, whatever their ids: of rows with one id and different texts one stays, a null id comes behind all
    others, and a row that repeats the one that stays, id and text, is the same document and stays. Texts without words are in no
    group and stay.
    """
    rows, roots = classes_of(docs, n_words, percent, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    nodes = rows.filter("node is not null").groupBy("node").agg(best.alias("best"))
    keys = best_of_component(nodes, roots, "best").select("node", F.col("best.row_key").alias("stays"))
    gone = rows.join(keys, "node").filter("row_key <> stays").select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key")).distinct()
    own_id = F.col(f"`{id_col}`").cast("long")
    key = F.xxhash64(own_id, F.col(f"`{text_col}`").cast("string"))
    kept = docs.join(small(materialize(gone, "gone")), own_id.eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
