"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary, the words of either corpus, and count every word and every pair
of neighbours in them; the counts grow with the corpora and are never gathered in one place.

    P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu),   P(w) = (c(w) + 1) / (N + V)

c(v) of the start of a text is the number of texts with words; N is the number of words, V of
different ones. A document's loss under a model is its mean -ln P a word, its score target less
background loss: the lower, the more it resembles the target.

1. Texts are dealt by id into chunks of about ``CHUNK_BYTES``. A chunk counts its different words
   and pairs, by 64-bit hashes, and sends them, sorted, to as many buckets of the hash range.
2. A bucket sums the counts of all chunks and answers each chunk with the totals of what it sent. A
   word or pair comes at most once from a chunk, so frequent ones make no bucket hot.
3. A chunk, which shuffle has kept, meets its answers and scores its documents.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text of a chunk; there are as many chunks, and buckets, as the texts fill.
CHUNK_BYTES = 8 << 20
MU = 50.0
#: Roles of a row: its text is scored, counts in the background, counts in the target; its id marks
#: a document of the target.
SCORED, BACKGROUND, TARGET, MARK = 1, 2, 4, 8
#: Rows that share an id are dealt into this many chunks by their texts.
SPREAD = 8
_ODD = np.uint64(1)
_START = np.uint64(0x9E3779B97F4A7C14)
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """XXH64 of words, remembered for the words in use; word hashes are even, pair hashes odd."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word) & ~1
        return h


_known = _Hashes()


def token_hashes(text: bytes | None) -> np.ndarray:
    """The start mark and the lower-cased (A-Z) words; empty for a text without words."""
    words = text.lower().split() if text else []
    h = np.empty(len(words) + 1, np.uint64)
    h[0] = _START
    h[1:] = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    return h if words else h[:0]


class _Chunk:
    """The documents of a chunk, and its different words and pairs in order of their hashes."""

    def __init__(self, rows: pa.Table) -> None:
        self.ids, roles = rows.column("doc_id").to_pylist(), rows.column("role").to_numpy()
        marked = {i for i, r in zip(self.ids, roles.tolist(), strict=True) if r == MARK}
        at = np.flatnonzero(roles != MARK)
        self.ids = [self.ids[i] for i in at]
        self.roles = roles[at] | np.array([TARGET * (i in marked) for i in self.ids], roles.dtype)
        texts = rows.column("text").take(pa.array(at)) if len(at) else []
        tokens = [token_hashes(t.as_py()) for t in texts]
        self.sizes = np.array([len(h) for h in tokens], np.int64)
        flat = np.concatenate([np.empty(0, np.uint64), *tokens])
        first = np.cumsum(self.sizes) - self.sizes
        later = np.ones(len(flat), bool)
        later[first[self.sizes > 0]] = False
        self.later = np.flatnonzero(later)  # words, each after its predecessor
        pairs = (flat[self.later - 1] * _K1) ^ (flat[self.later] * _K2)
        pairs ^= pairs >> np.uint64(31)
        pairs = (pairs * _K1) | _ODD
        self.keys, place = np.unique(np.concatenate([flat, pairs]), return_inverse=True)
        self.word, self.pair = place[: len(flat)], place[len(flat) :]
        self.owner = np.repeat(np.arange(len(tokens)), self.sizes)

    def counts(self, role: int) -> np.ndarray:
        has = (self.roles & role) > 0
        mine = np.concatenate([self.word[has[self.owner]], self.pair[has[self.owner[self.later]]]])
        return np.bincount(mine, minlength=len(self.keys))


def _narrow(x: np.ndarray) -> bytes:
    """Counts in a byte each; from 255 on, the rest follows in eight bytes."""
    more = x[x >= 255] - 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + more.astype(np.uint64).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    x[x == 255] += np.frombuffer(raw, np.uint64, offset=n).astype(np.int64)
    return x


def _pack(keys: np.ndarray) -> bytes:
    """Ascending hashes: the first, and the steps to the others in as many bytes as the longest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    width = raw[8]
    steps = np.frombuffer(raw[9:], np.uint8).reshape(-1, width)
    full = np.zeros((len(steps) + 1, 8), np.uint8)
    full[0] = np.frombuffer(raw, np.uint8, 8)
    full[1:, :width] = steps
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def _ask(buckets: int):
    """A chunk's different words and pairs with their counts, cut into buckets of the hash range."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)

    def run(rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows)
        number = rows.column("chunk")[0].as_py()
        background, target = chunk.counts(BACKGROUND), chunk.counts(TARGET)
        cut = [0, *np.searchsorted(chunk.keys, edges).tolist(), len(chunk.keys)]
        spans = [slice(lo, hi) for lo, hi in zip(cut, cut[1:], strict=False)]
        return pa.table({"bucket": pa.array(range(buckets), pa.int32()), "chunk": pa.array([number] * buckets, pa.int32()), "keys": [_pack(chunk.keys[s]) for s in spans], "background": [_narrow(background[s]) for s in spans], "target": [_narrow(target[s]) for s in spans]})

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """To each chunk the totals of what it asked for, with the bucket's words and sums."""
    asked = [_unpack(k.as_py()) for k in rows.column("keys")]
    sizes = [len(k) for k in asked]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    word = ((keys & _ODD) == 0) & (keys != _START)
    out = {"chunk": rows.column("chunk"), "bucket": rows.column("bucket")}
    ends = np.cumsum(sizes)
    totals = []
    for side in ("background", "target"):
        sent = np.concatenate([_wide(c.as_py(), n) for c, n in zip(rows.column(side), sizes, strict=True)])
        totals.append(np.bincount(place, weights=sent, minlength=len(keys)).astype(np.int64))
        mine = totals[-1][place]
        out[side] = [_narrow(mine[end - n : end]) for end, n in zip(ends.tolist(), sizes, strict=True)]
        out[f"{side}_words"] = pa.array([int(totals[-1][word].sum())] * len(sizes), pa.int64())
    out["vocabulary"] = pa.array([int((totals[0] + totals[1] > 0)[word].sum())] * len(sizes), pa.int64())
    out["n_keys"] = pa.array(sizes, pa.int64())
    return pa.table(out)


_ANSWER = "chunk int, bucket int, background binary, background_words long, target binary, target_words long, vocabulary long, n_keys long"


def _score(mu: float):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk, answers = _Chunk(rows), answers.sort_by("bucket")
        vocabulary = sum(answers.column("vocabulary").to_pylist())
        sizes = answers.column("n_keys").to_pylist()
        words = chunk.sizes - (chunk.sizes > 0)
        loss = {}
        for side in ("target", "background"):
            count = np.concatenate([_wide(c.as_py(), n) for c, n in zip(answers.column(side), sizes, strict=True)]).astype(float)
            all_ = sum(answers.column(f"{side}_words").to_pylist())
            this, last = chunk.word[chunk.later], chunk.word[chunk.later - 1]
            single = (count[this] + 1) / max(1, all_ + vocabulary)
            each = -np.log((count[chunk.pair] + mu * single) / (count[last] + mu))
            loss[side] = np.bincount(chunk.owner[chunk.later], weights=each, minlength=len(words)) / np.maximum(words, 1)
        scored = (chunk.roles & SCORED) > 0
        none = (words == 0)[scored]
        column = lambda x: pa.array(x[scored], pa.float64(), mask=none)
        ids = pa.array([i for i, s in zip(chunk.ids, scored.tolist(), strict=True) if s], pa.int64())
        return pa.table({"doc_id": ids, "n_tokens": pa.array(words[scored], pa.int64()), "target_loss": column(loss["target"]), "background_loss": column(loss["background"]), "score": column(loss["target"] - loss["background"])})

    return run


def cross_entropy_difference(docs: DataFrame, target: DataFrame | None = None, background: DataFrame | None = None, target_ids: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, chunk_bytes: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    The target corpus are the texts of ``target``, the rows of ``docs`` whose id is in ``target_ids``
    (its ``id_col`` is read), or both; the background those of ``background``, else ``docs`` itself.
    Words are the white-space separated pieces, A-Z lower-cased. A null or wordless text has 0
    tokens and null losses and score. Without counts a model is uniform over the vocabulary.
    Repeated rows count and are scored each. An empty table gives an empty result. Other columns
    are not read.
    """
    key, salt = F.col("doc_id"), F.pmod(F.xxhash64("text"), F.lit(SPREAD))

    def rows(df: DataFrame, role: int, named: bool = False) -> DataFrame:
        id_ = F.col(id_col).cast("long") if named else F.lit(None).cast("long")
        return df.select(id_.alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.lit(role).alias("role")).withColumn("salt", salt)

    parts = [rows(docs, SCORED if background is not None else SCORED | BACKGROUND, named=True)]
    parts += [rows(df, role) for df, role in ((background, BACKGROUND), (target, TARGET)) if df is not None]
    every = reduce(DataFrame.unionByName, parts)
    size = every.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + size // (chunk_bytes or CHUNK_BYTES)
    if target_ids is not None:
        marks = target_ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
        every = every.unionByName(marks.select("doc_id", F.lit(None).cast("binary").alias("text"), F.lit(MARK).alias("role"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(SPREAD)])).alias("salt")))
    dealt = F.when(key.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(key, "salt"))
    every = every.select(F.pmod(dealt, F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text", "role")
    asked = every.groupBy("chunk").applyInArrow(_ask(chunks), "bucket int, chunk int, keys binary, background binary, target binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    return every.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(mu), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
