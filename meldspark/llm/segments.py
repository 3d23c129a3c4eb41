"""Texts as segments that a tokenizer can take one by one, and the two tokenizers' vocabularies as bytes.

A text is cut before a run of white space that begins with a space and follows other characters.
Merges cannot cross such a cut where no entry of a vocabulary is what stands before it, or an end of
that, with a space and more after it, which is read off the vocabulary; elsewhere the text stays whole. Byte-level
pre-tokenizers begin a new piece at the start of every run of white space anyhow, so nothing on
one side of a cut depends on the other. White space at the end of a text stays with what it follows.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct segments that a worker remembers.
REMEMBERED = 1_000_000
#: Segments that are tokenised as one text.
TOGETHER = 100


def joins(vocabulary: Iterable[bytes]) -> tuple[bytes, ...]:
    """What some entry has before a space, after which it goes on over the cut; not what ends in
    white space, where texts are not cut anyhow."""
    found = {v[:i] for v in vocabulary for i in range(1, len(v)) if v[i] == 32}
    return tuple(sorted(f for f in found if not f.decode("utf-8", "replace")[-1].isspace()))


def cut(text: str, joined: tuple[bytes, ...] = ()) -> list[str]:
    """The segments of a text, which make it up again. Only the first can begin with anything but a space."""
    parts = text.split(" ")
    if joined:
        whole = [i for i, p in enumerate(parts) if not p or p[-1].isspace() or p.encode().endswith(joined)]
    else:
        whole = [i for i, p in enumerate(parts) if not p or p[-1].isspace()]
    if not whole:
        return [parts[0], *map(" ".__add__, parts[1:])]
    whole, out, at = set(whole), [], 0
    for i in range(len(parts)):
        if i + 1 == len(parts) or i not in whole:
            out.append((" " if at else "") + " ".join(parts[at : i + 1]))
            at = i + 1
    if len(out) > 1 and out[-1].isspace():
        out[-2:] = [out[-2] + out[-1]]
    return out


def _odd(parts: pa.Array, joined: tuple[bytes, ...]) -> np.ndarray:
    """Parts after which a text is not simply cut: those that are empty, end in white space or may go on."""
    size = pc.binary_length(parts)
    odd = pc.or_(pc.equal(size, 0), pc.less(pc.binary_length(pc.utf8_rtrim_whitespace(parts)), size)).to_numpy(zero_copy_only=False)
    return odd | np.fromiter((p.encode().endswith(joined) for p in parts.to_pylist()), bool, len(parts)) if joined else odd


def number(texts: pa.Array, joined: tuple[bytes, ...] = (), divisible: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The segments of " " + text, for texts that are not null: (distinct segments without the space with
    which each begins, the number of each text's segments in it, how many there are of each text)."""
    if not divisible:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
    else:
        lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    if divisible and len(texts):
        size = lists.value_lengths().to_numpy()
        odd = np.logical_or.reduceat(_odd(coded.dictionary, joined)[coded.indices.to_numpy()], np.cumsum(size) - size)
        if odd.any():
            cuts = [[s[1:] for s in cut(" " + t, joined)] for t in texts.filter(pa.array(odd)).to_pylist()]
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            lists = pa.concat_arrays([lists.filter(pa.array(~odd)), pa.array(cuts, lists.type)]).take(pa.array(np.argsort(order)))
            coded = lists.flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), lists.value_lengths().to_numpy().astype(np.int64)


def byte_alphabet() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: visible Latin-1 characters stand for themselves,
    the other bytes, in order, for the characters from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one after the other."""
    return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Vocabulary:
    """A tokenizer with its entries as bytes."""

    entries: list[bytes]

    def _measure(self) -> None:
        self.joined = joins(self.entries)
        self.sizes = np.array([len(e) for e in self.entries], np.int64)

    def each(self, segments: list[str]) -> list[list[int]]:
        """The ids of each segment (which begin with a space) by itself."""
        raise NotImplementedError

    def many(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, how many of each). Some are tokenised as one text, as they would be side
        by side; their bytes tell where each ends. Where they do not, each is tokenised by itself."""
        every = pa.array(segments, pa.string())
        single = _odd(every, self.joined) if self.divisible else np.ones(len(segments), bool)
        size = pc.binary_length(every).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.concatenate([np.flatnonzero(~single), np.flatnonzero(single)])
        ids, counts, rest = [], [], []
        several, lone = [segments[i] for i in order[: (~single).sum()].tolist()], order[(~single).sum() :]
        groups = [several[lo : lo + TOGETHER] for lo in range(0, len(several), TOGETHER)]
        for k, found in enumerate(self.each(["".join(g) for g in groups])):
            of = order[k * TOGETHER : k * TOGETHER + len(groups[k])]
            found = np.array(found, np.int64)
            ends, upto = np.cumsum(size[of]), np.cumsum(self.sizes[found])
            at = np.searchsorted(upto, ends)
            if len(found) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                ids.append(found)
                counts.append((of, np.diff(at + 1, prepend=0)))
            else:
                rest.append(of)
        for of in [*rest, lone]:
            for i, one in zip(of.tolist(), self.each([segments[i] for i in of.tolist()]), strict=True):
                ids.append(np.array(one, np.int64))
                counts.append((np.array([i]), np.array([len(one)])))
        none = np.zeros(0, np.int64)
        flat, of, n = np.concatenate([none, *ids]), np.concatenate([none, *(c[0] for c in counts)]), np.concatenate([none, *(c[1] for c in counts)])
        starts, out = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        starts[of], out[of] = np.cumsum(n) - n, n
        return gathered(flat, starts, out), out


class ByteLevel(Vocabulary):
    """A byte-level BPE file of the tokenizers library. ``plain``: special tokens in texts are ordinary text."""

    def __init__(self, path: str, plain: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        alphabet, self.entries = byte_alphabet(), [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab().items():
            self.entries[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self._measure()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        #: Whether cuts hold: byte-level pieces, no changes before, spaces of a text not added.
        kind = made.get("pre_tokenizer") or {}
        self.divisible = made.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)

    def each(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]


class Pieces(Vocabulary):
    """A sentencepiece model, which puts a space before each text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.entries = []
        for i in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(i)
            self.entries.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self._measure()
        #: Whether cuts hold: white space is kept as it is, and a space is added before a text.
        self.divisible = b"".join(self.entries[i] for i in self.model.encode("a  b ")) == b" a  b "

    def each(self, segments: list[str]) -> list[list[int]]:
        return self.model.encode([s[1:] for s in segments], num_threads=1)


@lru_cache(maxsize=4)
def byte_level(path: str, plain: bool) -> ByteLevel:
    return ByteLevel(path, plain)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Memo:
    """Token ids of texts; a segment is tokenised once while it is remembered."""

    def __init__(self, tokenizer: ByteLevel) -> None:
        self.tokenizer = tokenizer
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = defaultdict(count().__next__)
        self.ids, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each)."""
        of = self.tokenizer
        parts, at, sizes = number(texts, of.joined, of.divisible)
        if len(self.known) > REMEMBERED:
            self._forget()
        words, before = parts.to_pylist(), len(self.known)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))  # a new one takes the next number
        if len(self.known) > before:
            ids, counts = of.many([" " + words[i] for i in np.flatnonzero(place >= before).tolist()])
            self.ids, self.sizes = np.concatenate([self.ids, ids.astype(np.uint32)]), np.concatenate([self.sizes, counts])
        # The first segment of a text has no space before it.
        begins = np.cumsum(sizes) - sizes
        firsts, back = np.unique(at[begins], return_inverse=True)
        at = place[at]
        heads = [np.array(x, np.uint32) for x in of.each([words[i] for i in firsts.tolist()])]
        length = np.concatenate([self.sizes, np.fromiter(map(len, heads), np.int64, len(heads))])
        at[begins] = len(self.sizes) + back
        n = length[at]
        out = gathered(np.concatenate([self.ids, *heads]), (np.cumsum(length) - length)[at], n)
        upto = np.concatenate([[0], np.cumsum(n)])
        return out, upto[begins + sizes] - upto[begins]


@lru_cache(maxsize=2)
def memo(path: str) -> Memo:
    """That of a worker, whatever its tasks."""
    return Memo(byte_level(path, False))
