"""Operator 10: a quality classifier from weak labels.

Nine heuristics vote good, bad or abstain on every document. Votes are counted by pattern (at most 3^9 patterns,
whatever the size of the table), and expectation-maximisation on those counts estimates the share of good documents
and each heuristic's accuracy. The posterior of a pattern is the label of its documents. On a bounded sample of them
(`sample_rows`, by a hash of the id, about evenly) a logistic scorer is fitted to these soft labels; its features are
words, shapes of words and repetitions, hashed to 2^18. Every document is then scored as a whole; a word's weight is
remembered, so scoring costs one lookup for each word.

Edge cases: a null text or one without words scores 0 and is rejected; null ids may be in the sample like others; an
empty table gives an empty table; repeated rows score alike; extra columns pass through, and of columns that clash
with `quality_score`, `weak_label` or `kept` the operator's values stay.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyetos.llm.common import table

DIMS = 1 << 18
#: The feature for repeated words; word hashes may fall on it as on any other.
REPEATS = 0
#: Texts under so many words give the heuristics nothing to go by.
SHORT = 12
BAD, GOOD, NONE = 0, 1, 2
SYMBOLS = b"#$%&*|~^<>{}[]\\/=_@+"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SPACES = b" \t\n\x0b\f\r"
#: White space to a space, symbols to #, sentence ends to a full stop.
CLASSES = bytes.maketrans(SPACES + SYMBOLS + b".?!", b" " * len(SPACES) + b"#" * len(SYMBOLS) + b"...")
#: Letters to a or A, digits to 0; other bytes of a character beyond ASCII count as small letters.
SHAPES = bytes.maketrans(LOWER + UPPER + b"0123456789" + bytes(range(128, 256)), b"a" * 26 + b"A" * 26 + b"0" * 10 + b"a" * 128)
_runs = re.compile(rb"(.)\1+", re.DOTALL)


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeats(words: list[bytes]) -> int:
    return sum(map(operator.eq, words, words[1:]))


def votes(text: bytes, words: list[bytes]) -> list[int]:
    """What each heuristic says of a text with these words, at least one."""
    n = len(words)
    if n < SHORT:
        return [NONE] * 9
    size = len(text) - _count(text, SPACES)
    upper, lower = _count(text, UPPER), _count(text, LOWER)
    classes = text.translate(CLASSES) + b" "

    def between(value: float, good: float, bad: float) -> int:
        return GOOD if value <= good else BAD if value >= bad else NONE

    stops = classes.count(b". ") / n
    return [
        between(_count(text, SYMBOLS) / size, 0.01, 0.08),  # symbols among bytes
        between(upper / max(1, upper + lower), 0.12, 0.4),  # capitals among letters
        between(text.count(b"!") / n, 0.05, 0.4),  # exclamation marks for each word
        between(words.count(b"|") / n, 0.01, 0.15),  # table bars among words
        between(classes.count(b"# ") / n, 0.03, 0.3),  # words that end in a symbol
        between(repeats(words) / n, 0.1, 0.3),  # words that repeat the one before
        between(1 - len(set(words)) / n, 0.7, 0.8),  # words seen before in the text
        NONE if n < 20 else GOOD if 0.02 <= stops <= 0.35 else BAD,  # sentence ends
        between(size / n, 9.0, 14.0),  # bytes of a word
    ]


#: Of a bad and of a good document, how likely a heuristic that speaks is to say bad or good, before any is seen. Heuristics
#: look for different faults, so each knows few bad documents, but hardly ever accuses a good one. Weight: a share of all documents.
PRIOR, PRIOR_WEIGHT = np.array([[0.2, 0.8], [0.003, 0.997]]), 0.05


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray]:
    """EM: (share of good documents, [class, labeller, vote] probabilities), from distinct vote patterns and their counts.

    Of a labeller that speaks, its accuracy on a class is its probability of that vote; silence tells nothing.
    """
    share, table = 0.8, np.repeat(PRIOR[:, None, :], patterns.shape[1], axis=1)
    cast = patterns[:, :, None] == np.arange(2)
    for _ in range(rounds):
        p = posterior(patterns, share, table)
        share = float(np.clip((counts * p).sum() / max(1, counts.sum()), 0.05, 0.98))
        for k, of in enumerate((1 - p, p)):
            seen = np.einsum("p,pjv->jv", counts * of, cast) + (1 + PRIOR_WEIGHT * counts.sum()) * PRIOR[k]
            table[k] = seen / seen.sum(axis=1, keepdims=True)
    return share, table


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """The probability that documents with these votes are good."""
    logs = np.concatenate([np.log(table), np.zeros((*table.shape[:2], 1))], axis=2)
    each = logs[:, np.arange(patterns.shape[1]), patterns]
    z = np.log(share / (1 - share)) + (each[GOOD] - each[BAD]).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _features(word: bytes) -> tuple[int, int]:
    shape = _runs.sub(rb"\1", word.translate(SHAPES))
    return xxhash.xxh3_64_intdigest(word.lower()) % DIMS, xxhash.xxh3_64_intdigest(b"\0" + shape) % DIMS


class _Known(dict):
    """Remembers what a function makes of a word."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes):
        if len(self) > 300_000:
            self.clear()
        self[word] = value = self.make(word)
        return value


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        patterns = ["".join(map(str, votes(t, words))) if t and (words := t.split()) else None for t in _texts(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string())], ["pattern"])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each sampled text its votes, and its features with their counts."""
    known = _Known(_features)
    for batch in batches:
        patterns, ids, times = [], [], []
        for t in _texts(batch):
            if t and (words := t.split()):
                found, n = np.unique(np.array([known[w] for w in words] + [(REPEATS, REPEATS)] * repeats(words), np.int32).ravel(), return_counts=True)
                patterns.append("".join(map(str, votes(t, words)))), ids.append(found.tobytes()), times.append((n / len(words)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(patterns, pa.string()), pa.array(ids, pa.binary()), pa.array(times, pa.binary())], ["pattern", "ids", "shares"])


def fit_scorer(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Logistic regression with soft labels, by Adam on the whole sample."""
    weights, bias = np.zeros(DIMS, np.float32), 0.0
    if not ids:
        return weights, bias
    column, value = np.concatenate(ids), np.concatenate(shares)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    moment, spread = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights[column] * value, minlength=len(ids)) + bias
        error = 1 / (1 + np.exp(-z)) - labels
        slope = np.append(np.bincount(column, error[row] * value, minlength=DIMS), error.sum()) / len(ids)
        slope[:-1] += 1e-6 * weights
        moment, spread = 0.9 * moment + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        step = 0.3 * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-6)
        weights, bias = (weights - step[:-1]).astype(np.float32), bias - float(step[-1])
    return weights, bias


def _score(weights: np.ndarray, bias: float, labels: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = weights.tolist()
        known = _Known(lambda w: sum(values[k] for k in _features(w)))
        for batch in batches:
            scores, weak = [], []
            for t in _texts(batch):
                words = t.split() if t else ()
                z = (sum(map(known.__getitem__, words)) + 2 * weights[REPEATS] * repeats(words)) / len(words) + bias if words else -np.inf
                scores.append(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))) if words else 0.0)
                weak.append(labels.get("".join(map(str, votes(t, words)))) if words else 0.0)
            columns = [batch.column(c) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("text"), pa.array(scores, pa.float64()), pa.array(weak, pa.float64())], [*names, "text", "quality_score", "weak_label"])

    return run


def quality(
    docs: DataFrame, *, threshold: float = 0.5, sample_rows: int = 10_000, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """The table with quality_score, weak_label and kept. `carry`: the columns to keep, else all."""
    docs = docs.drop("quality_score", "weak_label", "kept")
    names = docs.columns if carry is None else carry
    texts = docs.select(F.col(text_col).alias("text"))
    counted = texts.mapInArrow(_vote, "pattern string").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    spoken = [r for r in counted if r["pattern"] is not None]
    patterns = np.array([[int(c) for c in r["pattern"]] for r in spoken], np.int8).reshape(-1, 9)
    share, chances = fit_labellers(patterns, np.array([r["n"] for r in spoken], float))
    labels = dict(zip([r["pattern"] for r in spoken], posterior(patterns, share, chances).tolist(), strict=True))

    total = sum(r["n"] for r in counted)
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(10)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, total)))
    sample = docs.filter(part).select(F.col(text_col).alias("text")).mapInArrow(_featurise, "pattern string, ids binary, shares binary").toArrow()
    weights, bias = fit_scorer(
        [np.frombuffer(x, np.int32) for x in sample.column("ids").to_pylist()], [np.frombuffer(x, np.float32) for x in sample.column("shares").to_pylist()],
        np.array([labels[p] for p in sample.column("pattern").to_pylist()], np.float64),
    )
    shipped = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != text_col], F.col(text_col).alias("text"))
    schema = ", ".join(f"{c} {t}" for c, t in shipped.dtypes) + ", quality_score double, weak_label double"
    scored = shipped.mapInArrow(_score(weights, bias, labels), schema)
    back = [F.col("text").alias(text_col) if c == text_col else F.col(f"c{k}").alias(c) for k, c in enumerate(names)]
    return scored.select(*back, "quality_score", "weak_label", (F.col("quality_score") >= threshold).alias("kept"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, carry=["doc_id"]).select("doc_id", "quality_score", "weak_label", "kept")
