"""Texts that are close by the indel ratio, found by the subsequences that they share.

Texts of n and m characters reach a ratio if and only if they share a subsequence of a certain
length. Where they have few subsequences of that length, these are keys under which close texts
meet, and nothing else does. Where these are many, two texts first have to share a key of a half.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Subsequences of a text, of one length, that are used as keys.
KEYS = 300
#: Beyond so many, a text has keys only if its halves meet too many others.
LIGHT = 40
#: Texts that meet under one key of a half and are compared one by one.
BUCKET = 16


def shared(n: int, m: int, percent: int = 90, strict: bool = True) -> int | None:
    """Least common subsequence of texts of n and m characters whose ratio passes ``percent`` (or, not
    ``strict``, reaches it); None if none can."""
    least = percent * (n + m) // 200 + 1 if strict else -(-percent * (n + m) // 200)
    return least if 0 < least <= min(n, m) else None


def few(n: int, m: int, *rule) -> bool:
    """Whether keys find the close texts of these lengths."""
    return max(comb(n, shared(n, m, *rule)), comb(m, shared(n, m, *rule))) <= KEYS


def heavy(n: int, m: int, *rule) -> bool:
    """Whether keys find the close texts of these lengths, but are many, and two characters of each text
    at most are not shared."""
    return few(n, m, *rule) and max(n, m) - shared(n, m, *rule) <= 2 and max(comb(n, shared(n, m, *rule)), comb(m, shared(n, m, *rule))) > LIGHT


def light(n: int, m: int, *rule) -> bool:
    return few(n, m, *rule) and not heavy(n, m, *rule)


def partners(n: int, lengths: Iterable[int], *rule) -> list[int]:
    return [m for m in lengths if shared(n, m, *rule)]


def keys_of(text: str, lengths: Iterable[int], *rule, by=few) -> list[str]:
    """Keys of a text for partners of the given lengths, equal texts included. The last sign tells
    whether it is the shorter (``<``), the longer (``>``) or as long (``=``)."""
    n, out = len(text), []
    if not shared(n, n, *rule) or not by(n, n, *rule):
        out.append(f"{text}=")
    for m in partners(n, lengths, *rule):
        if by(n, m, *rule):
            side = "<" if n < m else ">" if n > m else "="
            head = f"{min(n, m)}|{max(n, m)}|"
            out += [f"{head}{s}{side}" for s in {"".join(c) for c in combinations(text, shared(n, m, *rule))}]
    return out


def halves_of(text: str, lengths: Iterable[int], *rule) -> list[str]:
    """Keys of which two close texts of ``heavy`` lengths share one, and some others too. What one text
    alone has, at most two characters on each side, is spread over two halves. Either one half has one
    of each at most: then the halves agree but for a character. Or one half has the two of one text and
    the other half those of the other: then the first half without two characters begins the other
    text, which has a key of another sign (``>``) for that."""
    n, out = len(text), set()
    for m in partners(n, lengths, *rule):
        if heavy(n, m, *rule):
            size = min(n, m) // 2
            head, tail = text[:size], text[n - size :]
            for mark, half in (("h", head), ("t", tail)):
                out |= {f"{size}{mark}{half[:i]}{half[i + 1 :]}=" for i in range(size)}
            if min(n, m) - shared(n, m, *rule) == 2:
                out |= {f"{size}b{''.join(c)}<" for c in combinations(head, size - 2)}
                out.add(f"{size}b{head[:-2]}>")
    return list(out)


def halved(texts: DataFrame, column: str, lengths: list[int], *rule) -> DataFrame:
    """The rows ``(key, sign, id)`` of the keys of halves; ``id`` is a hash of the text."""

    @F.pandas_udf(ArrayType(StringType()))
    def halves(of: pd.Series) -> pd.Series:
        return of.map(lambda text: halves_of(text, lengths, *rule))

    rows = texts.select(F.xxhash64(column).alias("id"), F.explode(halves(column)).alias("k"))
    sign = F.when(F.right("k", F.lit(1)) == "=", 0).when(F.right("k", F.lit(1)) == ">", 1).otherwise(2)
    return rows.select(F.xxhash64(F.expr("left(k, length(k) - 1)")).alias("key"), sign.alias("sign"), "id")


def bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sign, id) in order to the pairs (a, b) of ids that meet, of signs 0 and 0 or 1 and 2;
    of more than ``BUCKET`` rows of a key, only the ids, with themselves. No key's rows are gathered."""
    held, last, told = None, None, False

    def made(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def flush(key, sign, of):
        """Whole keys."""
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        group = np.cumsum(new) - 1
        crowded = (size[group] > BUCKET) & (sign[first][group] < 2)
        yield made(of[crowded], of[crowded])
        for d in range(1, min(BUCKET, int(size.max()))):
            i = np.flatnonzero((key[d:] == key[:-d]) & (size[group[d:]] <= BUCKET))
            i = i[np.where(sign[i] == 0, True, (sign[i] == 1) & (sign[i + d] == 2)) & (of[i] != of[i + d])]
            yield made(np.minimum(of[i], of[i + d]), np.maximum(of[i], of[i + d]))

    for batch in batches:
        rows = tuple(c.to_numpy() for c in batch.columns)
        if told:  # the rest of a key of which too many rows were seen
            rest = rows[0] == last
            yield made(*[rows[2][rest & (told[0] < 2)]] * 2)
            rows = tuple(x[~rest] for x in rows)
        if held is not None:
            rows = tuple(np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
        if not len(rows[0]):
            continue
        last, told, held = rows[0][-1], False, None
        cut = int(np.argmax(rows[0] == last))
        if cut:
            yield from flush(*(x[:cut] for x in rows))
        rows = tuple(x[cut:] for x in rows)
        if len(rows[0]) > BUCKET:
            told = (rows[1][0],)
            yield made(*[rows[2] if told[0] < 2 else rows[2][:0]] * 2)
        else:
            held = rows
    if held is not None:
        yield from flush(*held)


def lengths_of(texts: DataFrame, column: str) -> list[int]:
    """Distinct lengths: at most as many as the longest text has characters."""
    return sorted(r[0] for r in texts.select(F.length(column)).distinct().collect() if r[0])


def keyed(texts: DataFrame, column: str, lengths: list[int], *rule, by=few) -> DataFrame:
    """The rows with ``key`` and ``side`` for each key of their text."""

    @F.pandas_udf(ArrayType(StringType()))
    def keys(of: pd.Series) -> pd.Series:
        return of.map(lambda text: keys_of(text, lengths, *rule, by=by))

    rows = texts.select("*", F.explode(keys(column)).alias("k"))
    return rows.select(*texts.columns, F.expr("left(k, length(k) - 1)").alias("key"), F.right("k", F.lit(1)).alias("side"))


def other_side(side: str) -> Column:
    return F.when(F.col(side) == "<", ">").when(F.col(side) == ">", "<").otherwise("=")
