"""SimHash near-dedup: fingerprints compared bit-sliced within buckets.

Fingerprints that link at a few bits. They are collapsed to distinct values. Two values that differ in at most
``radius`` bits agree on all of at least ``b - radius`` of ``b`` bit blocks, so each value is
filed once for every choice of ``b - radius`` blocks and compared only inside its buckets. There
the values stand vertically: one arbitrary-precision integer per bit, whose bit i belongs to the
i-th value. Shifting such a plane by d and xor-ing compares every value with its d-th neighbour
at once; carry-save counters sum the planes, and a block is abandoned as soon as every pair in it
has passed the radius.

Documents that link by similarity (``simhash_dedup``). The similarity of 0.8 moves some 15 % of the
bits of a fingerprint, so it takes a longer one, of 256 bits, to tell, and no choice of blocks stays
equal. Texts are filed instead under eight minima of shingle hashes, each of which two texts share
with a chance of their similarity (all eight are missed 3 in a million times at 0.8), and compared
bit-sliced inside those buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from ..operators.components import connected_components
from ..operators.scratch import discard, materialize
from ._common import runs

BITS = 64
#: Rows compared in one bit-sliced block; larger buckets are first split by further blocks.
BLOCK = 4096
#: Numbers that rows are filtered by where few are needed; their table is broadcast.
BUCKETS = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``shingle``-word run of the lower-cased (A-Z) text; shorter texts give one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, n)


def fingerprints_of(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([hashes[i] for i in full])
    # Byte lanes hold up to 255: cut every document into runs of that length.
    cuts = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(cuts)])[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes[full])])[:-1]
    at = np.repeat(starts, cuts) + 255 * (np.arange(cuts.sum()) - np.repeat(first, cuts))
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & _LANES, at)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):  # little-endian: byte j of the lane holds bit 8 j + k
            out[full] |= (2 * ones[:, byte] > sizes[full]).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for lo in range(0, b.num_rows, 256):
                part = texts.slice(lo, 256)
                fp = fingerprints_of([shingle_hashes(t.as_py() or b"", shingle, seed) for t in part])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fp)``, a row for each row of ``docs``; null and wordless texts give 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprint_batches(shingle, seed), "doc_id long, fp long")


def _bits(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def _int(flags: np.ndarray) -> int:
    return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def close_pairs(fp: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with i < j of equal ``bucket`` (sorted) and at most ``radius`` differing bits.
    ``fp``: one 64-bit word a row, or a row of several."""
    n = len(fp)
    if n < 2:
        return
    vertical = np.unpackbits(np.ascontiguousarray(fp, ">u8").view(np.uint8).reshape(n, -1), axis=1)
    planes = [_int(x) for x in np.ascontiguousarray(vertical.T)]
    width = radius.bit_length() or 1
    preset = (1 << width) - 1 - radius  # so that the counters overflow just past the radius
    d = 0
    while (d := d + 1) < n:
        same = bucket[d:] == bucket[:-d]
        if not same.any():
            return
        mask = _int(same)
        counters = [mask if preset >> j & 1 else 0 for j in range(width)]
        over = 0
        for k, p in enumerate(planes):
            carry = (p ^ (p >> d)) & mask
            for j in range(width):
                counters[j], carry = counters[j] ^ carry, counters[j] & carry
                if not carry:
                    break
            else:
                over |= carry
            if k % 8 == 7 and over == mask:
                break
        if hit := mask & ~over:
            i = _bits(hit, n)
            yield i, i + d


def _link(fp: np.ndarray, bucket: np.ndarray, ids: np.ndarray, radius: int, free: int, out: list) -> None:
    """Append to ``out`` a star (id, smallest id) for each group of linked values in the buckets.

    ``free``: mask of the bits in which values of one bucket may still differ."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    lo = np.concatenate([[0], edges])
    hi = np.concatenate([edges, [len(fp)]])
    start = 0
    while start < len(lo):
        if hi[start] - lo[start] > BLOCK and bin(free).count("1") > 3 * (radius + 1):
            _split(fp[lo[start] : hi[start]], ids[lo[start] : hi[start]], radius, free, out)
            start += 1
            continue
        end = start + 1  # as many whole buckets as fit in a block
        while end < len(lo) and hi[end] - lo[start] <= BLOCK:
            end += 1
        s = slice(lo[start], hi[end - 1])
        root, own = np.arange(s.stop - s.start), ids[s]
        for i, j in close_pairs(fp[s], bucket[s], radius):
            new = root[i] != root[j]
            for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
                a, b = root[x], root[y]
                if a != b:
                    root[root == max(a, b)] = min(a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        out.append((own[moved], own[root[moved]]))
        start = end


def _split(fp: np.ndarray, ids: np.ndarray, radius: int, free: int, out: list) -> None:
    """A bucket too large for one block: of radius + 1 parts of its free bits, near values share one."""
    bits = [i for i in range(BITS) if free >> i & 1]
    for part in np.array_split(np.array(bits), radius + 1):
        mask = sum(1 << int(i) for i in part)
        key = fp & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        _link(fp[order], key[order], ids[order], radius, free & ~mask, out)


def _link_batches(masks: list[int], radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            out: list = []
            choice, key = t.column(0).to_numpy(), t.column(1).to_numpy()
            fp, ids = t.column(2).to_numpy().view(np.uint64), t.column(3).to_numpy()
            for c in np.unique(choice).tolist():
                s = choice == c
                _link(fp[s], key[s], ids[s], radius, ~masks[c] & (1 << BITS) - 1, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def _choices(count: int, radius: int) -> list[int]:
    """Masks of the block choices; more and finer blocks as the number of fingerprints grows, so
    that buckets of evenly spread fingerprints stay small. Every setting finds every pair."""
    blocks = radius + 1
    while blocks < radius + 6 and (blocks - radius) * (BITS // blocks) < count.bit_length() - 4:
        blocks += 1
    parts = [sum(1 << int(i) for i in p) for p in np.array_split(np.arange(BITS), blocks)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(groups: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct ``(fp, rep)`` to edges ``(a, b)`` of reps: a spanning forest of every bucket's links."""
    masks = _choices(groups.count(), radius)
    filed = groups.where("rep is not null").select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("f"), "fp", "rep"
    ).select("f.c", "f.key", "fp", "rep")
    filed = filed.repartition("c", "key").sortWithinPartitions("c", "key", "rep")
    return filed.mapInArrow(_link_batches(masks, radius), "a long, b long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, a row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like others. A row with a null id is kept,
    takes part in no component of its own making, and gets the smallest id it reaches, or null.
    Repeated rows are repeated in the result; each row takes the component of its own text. Other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    groups = materialize(groups, "simhash-groups")
    parts = connected_components(near_links(groups, radius))
    of = groups.join(parts, groups.rep == parts.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# --- Documents that link by similarity

WORDS, MINIMA = 4, 8  # of 64 bits a fingerprint; of shingle hashes
OPEN, CERTAIN = 1, 2  # kinds of links
#: Of the runs of a block of rows that are compared one by one, and columns of a table of theirs.
BLOCK_BYTES, COLUMNS = 1 << 19, 2048
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th hash that is independent of the others, from one."""
    h = (h ^ (h >> np.uint64(29 + k % 4))) * _MIX[k]
    return h ^ (h >> np.uint64(32))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, shingle: int, known: dict) -> np.ndarray:
    """A hash of each different ``shingle``-word run (fewer words: of all); A-Z lower-cased."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = h[:n].copy()
    for i in range(1, min(shingle, len(words))):
        out = (out ^ (out >> np.uint64(31))) * _MIX[0] + h[i : i + n]
    return np.unique(_mixed(out, 3))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of ``WORDS``) and minima (rows of ``MINIMA``) of sets of shingle hashes;
    those of an empty set are zero."""
    fp = np.stack([fingerprints_of([_mixed(h, k) for h in sets]) for k in range(WORDS)], axis=1)
    low = np.zeros((len(sets), MINIMA), np.uint64)
    full = [i for i, h in enumerate(sets) if len(h)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        first = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k in range(MINIMA):
            low[full, k] = np.minimum.reduceat(_mixed(flat, k) * _MIX[(k + 3) % MINIMA], first)
    return fp, low


def _signed_batches(at: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            texts = b.column(1).field(at).cast(pa.binary())
            for lo in range(0, b.num_rows, 256):
                fp, low = signatures([shingles(t.as_py(), shingle, known) for t in texts.slice(lo, 256)])
                both = [pa.array([r.tobytes() for r in fp], pa.binary()), pa.array(list(low.view(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), *both, b.column(1).slice(lo, 256)], names=["doc_id", "fp", "low", "row"])

    return run


class _Links:
    """Links that are found: those so close that they are certain, and those to be checked. Of these
    there is one, the closest, for each two groups of rows that certain links make: ``open`` if it is
    in a spanning forest, else ``spare``; these are as many as pairs of groups, and told if asked for."""

    def __init__(self, near: int, far: int, spares: bool = True) -> None:
        self.near, self.far, self.spares = near, far, spares
        self.certain: list[tuple[np.ndarray, np.ndarray]] = []
        self.open: list[tuple[np.ndarray, np.ndarray]] = []
        self.spare: list[tuple[np.ndarray, np.ndarray]] = []


def _distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).sum(axis=-1, dtype=np.int64)


def _closest(one: np.ndarray, two: np.ndarray) -> tuple[int, int, int]:
    """(distance, i, j) of the closest rows, a few of the first at a time."""
    best, step = (1 << 30, 0, 0), max(1, (1 << 20) // len(two))
    for lo in range(0, len(one), step):
        d = _distances(one[lo : lo + step, None], two[None])
        at = int(d.argmin())
        best = min(best, (int(d.flat[at]), lo + at // len(two), at % len(two)))
    return best


def _leaders(fp: np.ndarray, ids: np.ndarray, links: _Links) -> None:
    """Close rows of a large bucket: every row that no leader before it surely reached leads, and the
    others follow the first that did. Two leaders whose followers can be close, by the distance between
    the leaders and from each to its farthest follower, have these compared one by one."""
    owner, leads, reach = np.full(len(fp), -1), [], []
    for row in range(len(fp)):
        if owner[row] >= 0:
            continue
        rest = row + np.flatnonzero(owner[row:] < 0)
        distance = _distances(fp[rest], fp[row])
        own = distance <= links.near
        owner[rest[own]] = len(leads)
        leads.append(row)
        reach.append(int(distance[own].max()))
    leads, reach = np.array(leads), np.array(reach)
    at = np.flatnonzero(ids != ids[leads[owner]])
    links.certain.append((ids[at], ids[leads[owner[at]]]))
    order = np.argsort(owner, kind="stable")
    rows = np.split(order, np.cumsum(np.bincount(owner, minlength=len(leads)))[:-1])
    root, found = np.arange(len(leads)), []
    for x in range(len(leads) - 1):
        apart = _distances(fp[leads[x + 1 :]], fp[leads[x]])
        for y in (x + 1 + np.flatnonzero(apart <= links.far + reach[x] + reach[x + 1 :])).tolist():
            distance, i, j = _closest(fp[rows[x]], fp[rows[y]])
            if distance <= links.far:
                found.append((distance, x, y, rows[x][i], rows[y][j]))
    _linked_groups(found, root, ids, links)


def _linked_groups(found: list, root: np.ndarray, ids: np.ndarray, links: _Links) -> None:
    """The closest rows (distance, group, group, i, j) of groups: certain ones are links, and so are the
    others in order of their distance, those that close a circle as spare ones."""
    out: dict[str, list] = {"certain": [], "open": [], "spare": []}
    top = list(range(len(root)))

    def of(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for distance, x, y, i, j in sorted(found):
        a, b = of(x), of(y)
        sure = distance <= links.near
        if a != b:
            top[max(a, b)] = min(a, b)
        elif sure or not links.spares:
            continue
        out["certain" if sure else "open" if a != b else "spare"].append((ids[i], ids[j]))
    for kind, pairs in out.items():
        if pairs:
            x, y = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
            getattr(links, kind).append((x, y))


def _block(fp: np.ndarray, bucket: np.ndarray, ids: np.ndarray, links: _Links) -> None:
    """A spanning forest of the certain links of each bucket, and the closest other link of each two
    groups that these make."""
    root, open_ = np.arange(len(fp)), []

    def join(i: np.ndarray, j: np.ndarray) -> None:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root[x], root[y]
            if a != b:
                root[root == max(a, b)] = min(a, b)

    for i, j in close_pairs(fp, bucket, links.far):
        distance = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1)
        sure = (distance <= links.near) & (root[i] != root[j])
        join(i[sure], j[sure])
        rest = distance > links.near
        open_.append((i[rest], j[rest], distance[rest]))
    moved = np.flatnonzero(root != np.arange(len(root)))
    links.certain.append((ids[moved], ids[root[moved]]))
    if open_:
        i, j, distance = (np.concatenate(x) for x in zip(*open_, strict=True))
        apart = root[i] != root[j]
        i, j, distance = i[apart], j[apart], distance[apart]
        order = np.argsort(distance, kind="stable")
        a, b = root[i[order]], root[j[order]]
        first = order[np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b), return_index=True)[1]]
        _linked_groups([*zip(distance[first].tolist(), root[i[first]].tolist(), root[j[first]].tolist(), i[first].tolist(), j[first].tolist(), strict=True)], root, ids, links)


def _similar(fp: np.ndarray, low: np.ndarray, ids: np.ndarray, bucket: np.ndarray, links: _Links, used: frozenset) -> None:
    """Links of close rows with equal ``bucket`` (sorted). A bucket too large for one block is divided
    by each other minimum; what that does not divide is much alike, and led."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    lo, hi = np.r_[0, edges], np.r_[edges, len(bucket)]
    keep = hi - lo > 1
    lo, hi = lo[keep], hi[keep]
    large = hi - lo > BLOCK
    for a, b in zip(lo[large].tolist(), hi[large].tolist(), strict=True):
        for k in set(range(low.shape[1])) - used:
            key = low[a:b, k]
            most = np.unique(key, return_counts=True)[1].max()
            if 2 * most > b - a or len(used) > 2:
                _leaders(fp[a:b], ids[a:b], links)
                break
            order = np.argsort(key, kind="stable")
            _similar(fp[a:b][order], low[a:b][order], ids[a:b][order], key[order], links, used | {k})
    lo, hi = lo[~large], hi[~large]
    start = 0
    while start < len(lo):  # as many whole buckets as fit in a block
        end = int(np.searchsorted(np.cumsum(hi[start:] - lo[start:]), BLOCK, "right")) + start
        end = max(end, start + 1)
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[start:end].tolist(), hi[start:end].tolist(), strict=True)])
        _block(fp[at], bucket[at], ids[at], links)
        start = end


def _forest(pairs: list) -> tuple[np.ndarray, np.ndarray]:
    """A star (id, smallest id) for each group that the pairs link."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, np.int64),) * 2
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while True:  # smallest labels along links, then along the roots
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _similar_batches(near: int, far: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            links = _Links(near, far, False)
            which, key, ids = (t.column(i).to_numpy() for i in (0, 1, 4))
            fp = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
            low = t.column(3).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            for k in np.unique(which).tolist():
                s = which == k
                _similar(fp[s], low[s], ids[s], key[s], links, frozenset([k]))
            for pairs, kind in ((_forest(links.certain), CERTAIN), (links.open, OPEN)):
                a, b = pairs if kind == CERTAIN else [np.concatenate(x) for x in zip(*pairs, strict=True)] if pairs else ([], [])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

    return run


def similarity_radii(similarity: float, bits: int = 64 * WORDS) -> tuple[int, int]:
    """Distances of fingerprints below which a Jaccard similarity is certain, and beyond which it is
    not met: 3.3 standard deviations below, and 2.3 above the mean at the similarity."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    mean, deviation = bits * share, math.sqrt(bits * share * (1 - share))
    return int(mean - 3.3 * deviation), int(mean + 2.3 * deviation)


def _set_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            sets = [shingles(t.as_py(), shingle, known).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["number", "runs"])

    return run


def _alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Of sets of run hashes, which two are similar, by products of the table of those that some share."""
    size = np.array([len(x) for x in sets])
    value, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, place = np.repeat(np.arange(len(sets)), size), np.where(count > 1, np.cumsum(count > 1) - 1, -1)[place]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    edge = np.searchsorted(place, np.arange(0, int((count > 1).sum()) + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        table = np.zeros((len(sets), COLUMNS), np.float32)
        table[row[lo:hi], place[lo:hi] - k * COLUMNS] = 1
        both += table @ table.T
    np.fill_diagonal(both, size)
    return both >= similarity * (size[:, None] + size[None] - both)


def _alike_batches(similarity: float):
    """Two blocks of rows (.., number, part, runs) to links of similar rows of different parts: a star for
    each group of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            edge = np.r_[0, np.flatnonzero(np.any([np.diff(t.column(i).to_numpy()) != 0 for i in range(3)], axis=0)) + 1, t.num_rows]
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                number, part = (t.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4))
                if (part == part[0]).all():
                    continue
                i, j = np.nonzero(_alike([np.frombuffer(x.as_py(), np.uint64) for x in t.column(5).slice(lo, hi - lo)], similarity) & (part[:, None] < part[None]))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest([(number[i], number[j])])], names=["a", "b"])

    return run


def _checked_batches(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(r.as_py(), np.uint64) for r in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, null last, and of rows of one
    id the first. Columns as they were.

    Texts are near copies if their different ``shingle``-word runs have the given Jaccard similarity
    or more: candidates are told by the distance of 256-bit fingerprints, and those that it does not
    settle are checked run by run. Groups are those reachable.
    Equal texts are one group whatever their number. Null and wordless texts are alike, and equal
    to each other only. An empty table gives an empty result. Rows are written once with their
    signatures, and once shuffled to those that stay, by number, as the kept ones grow with the input.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = StructType().add("doc_id", "long").add("fp", "binary").add("low", ArrayType(LongType())).add("row", docs.schema)
    signed = rows.mapInArrow(_signed_batches(docs.columns.index(text_col), shingle), schema)
    signed = materialize(signed.withColumn("number", F.monotonically_increasing_id()), "signatures")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "number")
    groups = materialize(signed.groupBy("fp", "low").agg(F.min(order).alias("first")).select("fp", "low", "first.doc_id", "first.number"), "signature-groups")
    filed = groups.select(F.posexplode("low").alias("which", "key"), "fp", "low", "number").repartition("which", "key").sortWithinPartitions("which", "key", "number")
    near, far = similarity_radii(similarity)
    links = materialize(filed.mapInArrow(_similar_batches(near, far), "a long, b long, kind int"), "near-links")
    links = links.groupBy("a", "b").agg(F.max("kind").alias("kind"))

    def runs_of(asked: DataFrame) -> DataFrame:
        """The runs of distinct numbers."""
        text = F.col("row").getField(text_col).cast("binary").alias("text")
        # Rows that are not asked for are left out before the shuffle, by a table of at most BUCKETS numbers.
        bucket = F.pmod(F.xxhash64("number"), F.lit(BUCKETS))
        few = signed.select("number", text).join(F.broadcast(asked.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")
        sets = few.join(asked.hint("merge"), "number", "left_semi").mapInArrow(_set_batches(shingle), "number long, runs binary")
        return materialize(sets, "near-runs")

    def checked(pairs: DataFrame) -> DataFrame:
        """Of pairs of numbers, those that are similar, run by run."""
        sets = runs_of(pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct())
        both = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
        alike = materialize(both.mapInArrow(_checked_batches(similarity), "a long, b long"), "near-checked")
        discard(sets)
        return alike

    def apart(parts: DataFrame) -> DataFrame:
        """Links that failed between parts, by the parts that they would link."""
        of = lambda df, end, name: df.join(parts.select(F.col("id").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
        return of(of(links.where(F.col("kind") == OPEN), "a", "ca"), "b", "cb").where("ca <> cb").select("ca", "cb")

    parts = connected_components(links.where(F.col("kind") == CERTAIN).select("a", "b").union(checked(links.where(F.col("kind") == OPEN).select("a", "b"))))
    # Open links are a forest, and where one fails, other rows of what it would have linked may be similar. All
    # rows within reach of each other are in one group of links, so those of its parts are compared, block by block.
    reach = connected_components(apart(parts).toDF("a", "b"))
    if not reach.isEmpty():
        of = reach.select(F.col("id").alias("part"), F.col("component").alias("reach"))
        members = materialize(of.join(parts, of.part == parts.component, "left").select(F.coalesce("id", "part").alias("number"), "part", "reach"), "near-members")
        sets = runs_of(members.select("number"))
        rows = members.join(sets.hint("merge"), "number")
        count = rows.groupBy("reach").agg(F.greatest(F.ceil(F.sum(F.length("runs")) / BLOCK_BYTES), F.lit(1)).cast("int").alias("n"))
        own = F.pmod(F.xxhash64("number"), F.col("n")).cast("int")
        dealt = rows.join(count, "reach").select("reach", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"), "number", "part", "runs")
        dealt = dealt.select("reach", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "number", "part", "runs")
        dealt = dealt.repartition("reach", "x", "y").sortWithinPartitions("reach", "x", "y")
        found = materialize(dealt.mapInArrow(_alike_batches(similarity), "a long, b long"), "near-rest")
        discard(sets, members)
        if not found.isEmpty():
            parts = connected_components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found))
    joined = groups.join(parts, groups.number == parts.id, "left").select(F.coalesce("component", "number").alias("component"), "doc_id", "number")
    keep = joined.groupBy("component").agg(F.min(F.struct("doc_id", "number")).alias("first")).select(F.col("first.number").alias("number"))
    kept = signed.select("number", "row").join(keep.hint("merge"), "number", "left_semi")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
