"""Quality classifier: a weak-label model, and a hashed linear scorer trained on its posteriors.

Labellers vote good, bad or nothing on every document: thresholds on its look (capitals, symbols,
one word repeated, word runs repeated), a lexicon of features that set bad annotated documents
apart, and the annotators themselves where they looked. Votes of all documents are counted by
pattern (at most 3^labellers rows). Expectation-maximisation over those counts estimates how often
each labeller votes how on good and on bad documents, and so a posterior for every pattern. The
posteriors of a bounded sample of annotated and other documents train a logistic scorer on hashed
words and word beginnings, which then judges every document from its text alone.

Texts are taken apart once: votes and feature buckets are written, and voting of the lexicon,
fitting and scoring read those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.scratch import materialize

FEATURE_BITS = 22
#: Annotated documents that the lexicon and the scorer are fitted on, and others for the scorer.
SAMPLE, PLAIN = 20_000, 10_000
#: Bounds of the annotators' accuracy: above the lower they anchor the classes, below the upper the
#: other labellers can outvote them.
ANNOTATOR = (0.9, 0.99)
#: Documents whose chance of being good is below this are rejected.
THRESHOLD = 0.3
LABELLERS = ("capitals", "symbols", "one_word", "repeated_runs", "lexicon", "scorer", "annotator")
_PLACES = {name: 3**i for i, name in enumerate(LABELLERS)}
GOOD, BAD, NONE = 0, 1, 2
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_MARKS, _SPACES = list(MARKS), [9, 10, 11, 12, 13, 32]
_NO_MARKS = bytes(32 if c in MARKS else c for c in range(256))


class _Words(dict):
    """Numbers of the words in use; row i of ``buckets`` has the buckets of word i and of its beginnings."""

    SIZE = 200_000

    def __init__(self) -> None:
        self.buckets = np.zeros((self.SIZE, 3), np.int32)
        self.styles: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == len(self.buckets):  # one text with very many words
            self.buckets = np.concatenate([self.buckets, np.zeros_like(self.buckets)])
        self[word] = i
        self.buckets[i] = _bucket(word)
        for j, k in enumerate((4, 5), 1):
            if len(word) > k:
                self.buckets[i, j] = _bucket(b"%s~%d" % (word[:k], k))
        return i

    def style(self, mark: bytes) -> int:
        if mark not in self.styles:
            self.styles[mark] = _bucket(mark)
        return self.styles[mark]


def _bucket(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key) >> (64 - FEATURE_BITS)


def _level(x: float, good: float, bad: float) -> int:
    return BAD if x > bad else GOOD if x < good else NONE


def look(text: str | None, known: _Words) -> tuple[list[int], np.ndarray]:
    """Votes of the first four labellers, and the distinct feature buckets of the text. Characters
    are counted by the class of their first byte; those beyond ASCII count as small letters."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    if not count.sum() - count[_SPACES].sum():
        return [NONE, NONE, BAD, NONE], np.empty(0, np.int32)
    if len(known) > 150_000:
        known.clear()
    words = text.lower().encode("utf-8", "surrogatepass").translate(_NO_MARKS).split()
    n = len(words)
    at = np.fromiter(map(known.__getitem__, words), np.int64, n)
    distinct, times = np.unique(at, return_counts=True)
    upper = int(count[65:91].sum())
    letters = upper + int(count[97:123].sum()) + int(count[192:].sum())
    marks = count[_MARKS]
    capitals, symbols = upper / max(1, letters), int(marks.sum()) / len(text)
    top = int(times.max()) / n if n else 0.0
    repeated = 0.0
    if n > 2:
        place = np.searchsorted(distinct, at)
        runs = np.unique((place[:-2] * len(distinct) + place[1:-1]) * len(distinct) + place[2:])
        repeated = 1 - len(runs) / (n - 2)
    votes = [
        _level(capitals, 0.2, 0.5) if letters else NONE,
        _level(symbols, 0.06, 0.1) if n >= 8 else NONE,
        _level(top, 0.15, 0.3) if n >= 20 else NONE,
        _level(repeated, 0.1, 0.4) if n >= 20 else NONE,
    ]
    levels = (capitals, symbols if n >= 8 else 0, top if n >= 20 else 0, repeated if n >= 20 else 0)
    style = [known.style(b"\0%d>%d" % (i, k)) for i, x in enumerate(levels) for k in range(1, min(16, int(32 * x) + 1))]
    if n >= 20:
        style += [known.style(b"\0mark%c" % MARKS[i]) for i in np.flatnonzero(marks > 0.01 * len(text)).tolist()]
    found = np.unique(np.concatenate([known.buckets[distinct].ravel(), np.array(style, np.int32)]))
    return votes, found[found != 0].astype(np.int32)


def pack(features: np.ndarray) -> bytes:
    """Ascending buckets as 16-bit steps; 65535 is a step of that length that goes on."""
    step = np.diff(features, prepend=0)
    long = step // 65535
    if long.any():
        out = np.full(len(step) + int(long.sum()), 65535, np.uint16)
        out[np.cumsum(long + 1) - 1] = step % 65535
        return out.tobytes()
    return step.astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    step = np.frombuffer(packed, np.uint16)
    return np.cumsum(step, dtype=np.int32)[step != 65535]


def _looking(at: int):
    """Column ``at`` holds the text, or the row that has it as a field; that of rows passes through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            texts = b.column(1).field(at) if at >= 0 else b.column(1)
            looks = [look(t.as_py(), known) for t in texts]
            columns = [b.column(0), pa.array([_pattern(v) for v, _ in looks], pa.int32()), pa.array([pack(f) for _, f in looks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [b.column(1)] * (at >= 0), names=["doc_id", "votes", "features", "row"][: 3 + (at >= 0)])

    return run


def looked(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """``(doc_id, votes, features)`` of each row, written once: texts are taken apart nowhere else.
    With ``carry`` the row comes along."""
    key = F.col(id_col).cast("long").alias("doc_id")
    if not carry:
        rows = docs.select(key, F.col(text_col).cast("string").alias("text"))
        return materialize(rows.mapInArrow(_looking(-1), "doc_id long, votes int, features binary"), "looks")
    rows = docs.select(key, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = StructType().add("doc_id", "long").add("votes", "integer").add("features", "binary").add("row", docs.schema)
    return materialize(rows.mapInArrow(_looking(docs.columns.index(text_col)), schema), "looks")


def _tally(features: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Weights of the rows that have each bucket, summed row by row: no table but the result is made."""
    out = np.zeros(1 << FEATURE_BITS, weights.dtype)
    for f, w in zip(features, weights, strict=True):
        if w:
            np.add.at(out, f, w)
    return out


def _lexicon(features: list[np.ndarray], bad: np.ndarray, least: int = 8, times: float = 20.0) -> np.ndarray:
    """Buckets that occur in at least ``least`` bad documents, at ``times`` their rate in good ones."""
    b, g = _tally(features, (bad == 1).astype(np.int32)), _tally(features, (bad == 0).astype(np.int32))
    some = np.flatnonzero(b >= least)
    return some[b[some] / max(1, (bad == 1).sum()) > times * (g[some] + 1) / max(1, (bad == 0).sum())]


def _lexicon_vote(features: np.ndarray, flags: np.ndarray) -> int:
    hits = int(flags[features].sum())
    return BAD if hits >= 4 else GOOD if hits < 2 else NONE


def _pattern(votes: list[int]) -> int:
    return sum(v * 3**i for i, v in enumerate(votes))


def _scorer_vote(features: np.ndarray, model: tuple[np.ndarray, float] | None) -> int:
    if model is None:
        return NONE
    z = float(model[0][features].sum()) + model[1]  # 1.4: a chance of 0.8
    return BAD if z > 1.4 else GOOD if z < -1.4 else NONE


def _later_votes(features: list[np.ndarray], flags: np.ndarray, model: tuple[np.ndarray, float] | None) -> np.ndarray:
    """Places of the votes of lexicon and scorer in the pattern."""
    return np.array([_lexicon_vote(f, flags) * _PLACES["lexicon"] + _scorer_vote(f, model) * _PLACES["scorer"] for f in features], np.int64)


def _voting(voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(1).to_numpy() + _later_votes([unpack(f.as_py()) for f in b.column(2)], *voters.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.int32())], names=["doc_id", "pattern"])

    return run


def weak_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100, held: dict[int, tuple[float, float]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Votes (patterns x labellers) with counts to the posterior of bad for each pattern, and
    labeller tables P(vote | class) of shape (labellers, 2, 3).

    ``held`` keeps the accuracy of a labeller, where it votes, between two bounds. Bad documents
    are bad in different ways: without a labeller held above some accuracy the classes drift to
    the most common way, and one held below some accuracy can be outvoted by the others."""
    if not len(patterns):
        return np.empty(0), np.full((patterns.shape[1], 2, 3), 1 / 3)
    bad = np.where((patterns == BAD).any(axis=1), 0.9, 0.05)
    tables = np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - bad), counts * bad])
        prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        for j in range(patterns.shape[1]):
            low, high = (held or {}).get(j, (0.0, 1.0))
            for y in (GOOD, BAD):
                tally = np.bincount(patterns[:, j], weights=weight[y], minlength=3) + 0.5
                voted = tally[GOOD] + tally[BAD]
                tally[y] = min(max(tally[y], low * voted), high * voted)
                tally[1 - y] = max(voted - tally[y], 1e-6)
                tables[j, y] = tally / tally.sum()
        score = np.log(prior)[:, None] + sum(np.log(tables[j][:, patterns[:, j]]) for j in range(patterns.shape[1]))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return bad, tables


def fit_linear(features: list[np.ndarray], bad: np.ndarray, rounds: int = 300, rate: float = 0.2, penalty: float = 1e-5, least: int = 4, times: float = 2.5) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 buckets against soft labels, by full-batch Adam. Buckets in fewer
    than ``least`` bad rows, or not at ``times`` their rate in good ones, get no weight: else long
    texts would seem good for the many words that happened to stand in good ones only, and short
    ones bad for the want of them."""
    size = 1 << FEATURE_BITS
    weights, n = np.zeros(size, np.float32), len(features)
    if not any(map(len, features)):
        return weights, 0.0
    in_bad, in_good = _tally(features, bad), _tally(features, 1 - bad)
    used = np.flatnonzero(in_bad >= least)
    used = used[in_bad[used] / max(1e-9, bad.sum()) > times * (in_good[used] + 1) / max(1.0, n - bad.sum())]
    del in_bad, in_good
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    kept = [p[p >= 0] for p in (place[f] for f in features)]
    row, flat = np.repeat(np.arange(n), [len(p) for p in kept]), np.concatenate(kept)
    w, bias = np.zeros(len(used) + 1), np.log((bad.sum() + 1) / (n - bad.sum() + 1))
    w[-1] = bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[flat], minlength=n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - bad) / n
        g = np.append(np.bincount(flat, weights=error[row], minlength=len(used)) + penalty * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def _goodness(features: pa.Array, model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, bias = model
    z = np.array([float(weights[unpack(f.as_py())].sum()) + bias for f in features], float)
    return 1 / (1 + np.exp(np.clip(z, -30, 30)))


def _scoring(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_goodness(b.column(1), model.value))], names=["doc_id", "score"])

    return run


def gold_marks(labels: DataFrame) -> DataFrame:
    """``(doc_id, bad)``: what the annotators say of each document they looked at."""
    marks = F.greatest(1 - F.col("quality"), F.col("toxic")).cast("int")
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(marks).alias("bad")).where("bad is not null")


def _sample(looks: DataFrame, gold: DataFrame, sample: int, plain: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Votes, annotations and features of about ``sample`` annotated and ``plain`` other rows."""
    shares = [min(1.0, k / max(1, n)) for k, n in ((sample, gold.count()), (plain, looks.count()))]
    draw = F.pmod(F.xxhash64("doc_id", "features", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = looks.where("doc_id is not null").withColumn("draw", draw).where(F.col("draw") < max(shares))
    drawn = drawn.join(gold, "doc_id", "left").where(F.col("draw") < F.when(F.col("bad").isNull(), shares[1]).otherwise(shares[0]))
    table = drawn.orderBy("doc_id", "features").select("votes", F.coalesce("bad", F.lit(NONE)).alias("mark"), "features").toArrow()
    return table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy().astype(np.int64), [unpack(f.as_py()) for f in table.column(2)]


def _posteriors(looks: DataFrame, gold: DataFrame, flags: np.ndarray, model: tuple[np.ndarray, float] | None) -> dict[int, float]:
    """The chance of bad for each pattern of votes that occurs, counted over all rows."""
    seen = looks.mapInArrow(_voting(looks.sparkSession.sparkContext.broadcast((flags, model))), "doc_id long, pattern int").join(gold, "doc_id", "left")
    seen = seen.select((F.col("pattern") + F.coalesce("bad", F.lit(NONE)) * _PLACES["annotator"]).alias("pattern")).groupBy("pattern").count()
    table = seen.orderBy("pattern").collect()  # at most 3^labellers rows
    codes = np.array([r[0] for r in table], np.int64)
    posterior, _ = weak_label_model(codes[:, None] // list(_PLACES.values()) % 3, np.array([r[1] for r in table], float), held={LABELLERS.index("annotator"): ANNOTATOR})
    return dict(zip(codes.tolist(), posterior.tolist(), strict=True))


def fit_rounds(looks: DataFrame, labels: DataFrame, sample: int = SAMPLE, plain: int = PLAIN, rounds: int = 2) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, float]]]:
    """Weak labels (posteriors of bad) of the sampled rows and the scorer fitted to them, round by
    round. The lexicon comes from the annotated rows; from the second round on the scorer of the
    round before is a labeller too, so that it is not taught that what only it knows is good."""
    looks, gold = looks.select("doc_id", "votes", "features"), materialize(gold_marks(labels), "gold")
    votes, marks, features = _sample(looks, gold, sample, plain)
    known = np.flatnonzero(marks != NONE)
    flags = np.zeros(1 << FEATURE_BITS, bool)
    flags[_lexicon([features[i] for i in known], marks[known])] = True
    model = None
    for _ in range(rounds):
        of = _posteriors(looks, gold, flags, model)
        pattern = votes + _later_votes(features, flags, model) + marks * _PLACES["annotator"]
        soft = np.array([of[p] for p in pattern.tolist()], float)
        model = fit_linear(features, soft)
        yield soft, model


def fit_quality(looks: DataFrame, labels: DataFrame, sample: int = SAMPLE, plain: int = PLAIN):
    """The scorer (weights, bias) of the last round, broadcast: a table of fixed size."""
    model = None
    for _, model in fit_rounds(looks, labels, sample, plain):
        pass
    return looks.sparkSession.sparkContext.broadcast(model)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, plain: int = PLAIN) -> DataFrame:
    """``(doc_id, score)``, a row for each row of ``docs``: the scorer's chance that it is good.

    ``labels`` has doc_id, quality (1 good) and toxic (1 bad); a document is annotated bad if any
    of its rows calls it toxic or of no quality; null marks say nothing. About ``sample`` annotated
    and ``plain`` other documents, chosen by a hash, are fitted on; votes are counted over all
    documents. Null and wordless texts have no features and take the scorer's bias. Without labels
    there is no lexicon, and the scorer learns from the other labellers alone. Repeated rows are
    voted on and scored each. An empty table gives an empty result. Other columns are not read.
    """
    looks = looked(docs, id_col, text_col)
    return looks.select("doc_id", "features").mapInArrow(_scoring(fit_quality(looks, labels, sample, plain)), "doc_id long, score double")


def _keep_good(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = _goodness(b.column(0), model.value) >= threshold
            yield pa.RecordBatch.from_arrays([b.column(1).filter(pa.array(good))], names=["row"])

    return run


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, plain: int = PLAIN) -> DataFrame:
    """The rows of ``docs`` that the scorer gives at least ``threshold``; columns as they were. Each
    row is judged by its own text, written beside its features: documents are not shuffled. Cases
    as for ``quality_scores``."""
    looks = looked(docs, id_col, text_col, carry=True)
    model = fit_quality(looks, labels, sample, plain)
    kept = looks.select("features", "row").mapInArrow(_keep_good(model, threshold), StructType().add("row", docs.schema))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
