"""Segments, Simple-8b, token files and alignments against the tokenizers themselves."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from meldspark.llm import _common, alignment, segments, simple8b, tokenfiles

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = [*"     \n\t\r\x0b\x1c\x85\xa0 　", "a", "B", "é", "à", "日", "'s", "'ll", "12", "!", "...", "<|endoftext|>", "ing", "the", "x́", "<s>", "\x00", "\U0001f600"]
texts = st.lists(st.sampled_from(SIGNS), max_size=14).map("".join)


@settings(max_examples=600, deadline=None)
@given(texts)
def test_segments_are_tokenised_as_in_their_text(text):
    some = segments.cut(text)
    assert "".join(some) == text and all(s.startswith(" ") for s in some[1:])
    for plain in (True, False):
        of = segments.byte_level(A, plain)
        assert of.divisible and not of.joined
        assert [i for ids in of.each(some) for i in ids] == of.each([text])[0]
    if text:
        of = segments.pieces(B)
        some = segments.cut(" " + text)
        assert of.divisible and not of.joined and all(s[0] == " " for s in some)
        assert [i for ids in of.each(some) for i in ids] == of.each([" " + text])[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(texts, max_size=12), st.sampled_from([1, 2, 100]))
def test_texts_by_their_segments(some, together):
    had, segments.TOGETHER = segments.TOGETHER, together
    try:
        given_texts = pa.array(some, pa.string())
        parts, at, sizes = segments.number(given_texts)
        words = [" " + p for p in parts.to_pylist()]
        assert len(set(words)) == len(words)
        flat = iter([words[i] for i in at.tolist()])
        assert ["".join(next(flat) for _ in range(n)) for n in sizes.tolist()] == [" " + t for t in some]
        for of in (segments.byte_level(A, True), segments.pieces(B)):
            ids, counts = of.many(words)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == of.each(words) or not words
        of = segments.byte_level(A, False)
        for memo in (segments.Memo(of),):
            for _ in range(2):
                ids, counts = memo.encode(given_texts)
                assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == of.each(some) or not some
    finally:
        segments.TOGETHER = had


def test_no_cut_where_a_vocabulary_goes_on():
    joined = segments.joins([b"a b", b"  ", b" x", b"\xc2\xa0 ", b"of the"])
    assert joined == (b"a", b"of")
    assert segments.cut("a b of the if it xa  y z", joined) == ["a b", " of the", " if", " it", " xa  y", " z"]


def test_vocabularies_as_bytes():
    text = "Ab é日\x00\n z"
    a, b = segments.byte_level(A, True), segments.pieces(B)
    assert b"".join(a.entries[i] for i in a.each([text])[0]) == text.encode()
    assert b"".join(b.entries[i] for i in b.each([" " + text])[0]) == b" " + text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(numbers, block):
    words, sizes = simple8b.encode(np.array(numbers, np.uint64), block)
    assert sizes.sum() == len(words)
    assert simple8b.decode(words, sizes, len(numbers), block).tolist() == numbers
    # any block by itself
    ends = np.cumsum(sizes)
    for k in range(len(sizes)):
        part = numbers[k * block : (k + 1) * block]
        assert simple8b.decode(words[ends[k] - sizes[k] : ends[k]], sizes[k : k + 1], len(part), block).tolist() == part


def test_simple8b_packs_greedily():
    rnd = random.Random(3)
    numbers = [rnd.choice([0, 1, rnd.randrange(1 << 12), rnd.randrange(1 << 31), (1 << 60) + 5]) for _ in range(1000)]
    want, at = 0, 0
    while at < len(numbers):  # the most that fit, one word after the other
        fit = [c for w, c in zip(simple8b.WIDTHS, simple8b.COUNTS, strict=True) if all(x < 1 << w for x in numbers[at : at + c])]
        want, at = want + (1 if fit else 2), at + (max(fit) if fit else 1)
    assert len(simple8b.encode(np.array(numbers, np.uint64))[0]) == want


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ROWS = [(5, "Hello  world \n", 1), (None, "x <|endoftext|> y", 2), (3, None, 1), (3, "", 1), (7, "same words here", 0), (7, "same words here", 0), (7, "others", 0), (-4, "word " * 5000, 1), (9, "日本語の文 " * 50, 1)]


@pytest.mark.parametrize("at_once", [1 << 20, 1024, 3000])
def test_token_files(spark, tmp_path, monkeypatch, at_once):
    monkeypatch.setattr(tokenfiles, "AT_ONCE", at_once)
    of = Tokenizer.from_file(A)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, number int")
    got = tokenfiles.token_digests(docs, f"file://{tmp_path}/t", A).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -4, 3, 3, 5, 7, 7, 7, 9]
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    want = sorted((i or 0, len(ids), crc(ids)) for i, t, _ in ROWS for ids in [[*of.encode(t or "", add_special_tokens=False).ids, 2]])
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    assert tokenfiles.token_digests(docs.limit(0), f"file://{tmp_path}/none", A).collect() == []


def test_a_file_is_read_in_parts(tmp_path, monkeypatch):
    from pyarrow import fs

    rnd = random.Random(1)
    docs = [(i if i % 7 else None, [rnd.randrange(50257) for _ in range(rnd.choice([0, 1, 30, 5000]))]) for i in range(60)]
    path = str(tmp_path / "f.s8b")
    for at_once in (1024, 1 << 20):
        monkeypatch.setattr(tokenfiles, "AT_ONCE", at_once)
        file = tokenfiles.TokenFile(fs.LocalFileSystem().open_output_stream(path))
        for i, ids in docs:
            file.add(i, np.array(ids, "<u4").tobytes())
        assert file.close()[:2] == (60, sum(len(x) for _, x in docs))
        with fs.LocalFileSystem().open_input_file(path) as f:
            parts = list(tokenfiles.read_file(f))
        assert [(i, np.frombuffer(x, "<u4").tolist()) for ids, raw in parts for i, x in zip(ids, raw, strict=True)] == docs


def aligned(rows):
    """By definition, whole text by whole text, token by token."""
    one, two, alphabet = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), segments.byte_alphabet()
    one.encode_special_tokens = True
    found, counts = [], Counter()
    for doc, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        spans = []
        for ids, piece in ((a, lambda i: bytes(alphabet[c] for c in one.id_to_token(i))), (b, lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode())):
            raw = [piece(i) for i in ids]
            if not text or b"".join(raw) != (" " + text).encode():
                spans = None
                break
            at = [0]
            for r in raw:
                at.append(at[-1] + len(r))
            spans.append(list(zip(ids, at, at[1:], strict=False)))
        if spans is None:
            found.append((doc, None))
            continue
        links = [(x, y) for x, lo, hi in spans[0] for y, p, q in spans[1] if lo < q and p < hi]
        ends = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups = ["|".join(",".join(str(i) for i, lo, hi in side if before <= lo and hi <= end) for side in spans) for before, end in zip([0, *ends], ends, strict=False)]
        counts.update(links)
        found.append((doc, (len(a), len(b), len(groups), links, ";".join(groups))))
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    out = []
    for doc, f in found:
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, *f[:3], len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]))
    return out


@pytest.mark.parametrize(("chunk", "held"), [(1, 0), (300, 1 << 20), (1 << 25, 0), (1 << 25, 1 << 20)])
def test_alignments_are_those_of_whole_texts(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(alignment, "PAIRS", held)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    monkeypatch.setattr(alignment, "ENTRIES", 3)
    monkeypatch.setattr(_common, "SHARE", 20)  # some pairs are hot
    rnd = random.Random(2)
    words = ["the", "Token", "izers", "na\u00efve", "\u65e5\u672c", "don't", "x" * 9, "2024,", "<|endoftext|>", "</s>", "\n", "", "caf\u00e9.\nEnd", "\U0001f600", "-"]
    rows = [(i % 50, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40)))) for i in range(70)]
    rows += [(1, None), (2, ""), (3, " "), (4, "the \u2581 Token the"), (4, "Token the the"), (None, "the"), (6, "\u2581"), (7, "nospace" * 400)]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, segment string")
    want = aligned(rows)
    got = [tuple(r) for r in alignment.alignments(df, A, B).collect()]
    assert Counter(got) == Counter(want)
    assert sum(r[1] == 0 for r in got) == 4
    if chunk > 300:
        short = [tuple(r) for r in alignment.alignments(df, A, B, digest=True).collect()]
        assert Counter(short) == Counter((*w[:7], hashlib.sha256(w[7].encode()).hexdigest() if w[7] else "") for w in want)
        assert alignment.alignments(df.limit(0), A, B).collect() == []
        assert [tuple(r) for r in alignment.alignments(spark.createDataFrame([(6, "\u2581")], "doc_id long, text string"), A, B).collect()] == [(6, 0, 0, 0, 0, 0, 0, "")]


def test_undivided_texts_give_the_same(spark, monkeypatch):
    rows = [(i, f"some words {i}  and \n more") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(tuple, alignment.alignments(df, A, B).collect()))
    assert want == Counter(aligned(rows))
    whole = df.select("doc_id", F.regexp_replace("text", " ", "\u00a0").alias("text"))  # no spaces, no cuts
    assert Counter(map(tuple, alignment.alignments(whole, A, B).collect())) == Counter(aligned([(i, t.replace(" ", "\u00a0")) for i, t in rows]))


def test_segments_are_remembered_between_batches():
    """700,000 distinct segments are tokenised once; those of a later batch get numbers of their own."""

    class Letters:
        joined, divisible, seen = (), True, 0

        def each(self, found):
            return [[len(s)] for s in found]

        def many(self, found):
            self.seen += len(found)
            return np.array([1000 + len(s) for s in found], np.int64), np.ones(len(found), np.int64)

    of = Letters()
    known = segments.Memo(of)
    many = pa.array([" ".join(f"w{i}" for i in range(lo, lo + 70_000)) for lo in range(0, 700_000, 70_000)])
    first, sizes = known.encode(many)
    again, _ = known.encode(pa.concat_arrays([many, pa.array(["w1 new w1", "", "w12"])]))
    assert of.seen <= 700_002 and (again[: len(first)] == first).all() and sizes.tolist() == [70_000] * 10
    assert again[len(first) :].tolist() == [2, 1004, 1003, 0, 3]
