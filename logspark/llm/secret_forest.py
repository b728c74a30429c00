"""Secret scans with false positives removed by a random forest.

Candidates are values of known key formats, values assigned to names like ``token``, and long strings
without spaces. A forest of decision trees judges each by its length and character classes, how
likely its letter transitions are in the words of the corpus, how much of it dictionary words cover,
the path of its document, and the words next to it. It is trained on labelled findings.

The dictionary and the transitions come from counts over all words of all documents, taken per task
and summed; nothing is left out before the sum. A word is in the dictionary by its share of all words,
so no more than ``1 / MIN_SHARE`` words can be, however large the corpus and whatever its languages.
Texts are read twice, for the counts and for the candidates, and never shuffled; what is written down
is one narrow row a candidate. The forest is fitted on at most ``max_labelled`` labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, written

MAX_LABELLED = 6_000
MIN_SHARE = 2e-6  # of all words, for a word of the dictionary
MIN_COUNT = 3  # times a word is in the corpus at least
HELD = 300_000  # distinct words a task counts before it passes them on
TREES, DEPTH, LEAF = 40, 8, 3
THRESHOLD = 0.5

# Fixed formats of widely used keys.
FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"glpat-[A-Za-z0-9_-]{20}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}", r"sk_(?:live|test)_[A-Za-z0-9]{16,}", r"AIza[A-Za-z0-9_-]{35}",
    # Parts of a signed token are bounded, so that a failed start costs a bounded time.
    r"eyJ[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,4096}+\.[A-Za-z0-9_-]{8,}",
)
NAMES = "key|token|secret|passwd|password|pwd|credential|auth"
VALUE = r"[A-Za-z0-9+/_=.~-]"
FORMAT = "|".join(FORMATS)
# A name is looked into once and taken whole, so that a long word costs no more than its length.
CANDIDATE = re.compile(
    rf"(?P<format>\b(?:{FORMAT}))"
    rf"|(?P<name>\b(?=\w*(?:{NAMES}))\w++)(?P<glue>[\"']?\s*[:=]\s*[\"']?)(?P<assigned>{VALUE}{{8,}})"
    rf"|(?P<long>(?<!{VALUE}){VALUE}{{20,}})", re.IGNORECASE | re.ASCII)
IS_FORMAT = re.compile(FORMAT).fullmatch
HEX = re.compile("[0-9a-f]+|[0-9A-F]+").fullmatch
NAMED = re.compile(NAMES, re.IGNORECASE).search
PRETEND = re.compile("example|sample|dummy|placeholder|changeme|xxxx|your", re.IGNORECASE).search
WORD = re.compile(r"[^\W\d_]+")
TESTS = re.compile(r"(^|[/_.-])(tests?|fixtures?|examples?|docs?)([/_.-]|$)", re.IGNORECASE).search
CODE = re.compile(r"\.(py|js|ts|go|java|rb|sh|env|ya?ml|json|toml|ini|cfg|conf|tf)$",
                  re.IGNORECASE).search

OTHER = "\x80"  # no letter
WORDS, PAIRS, LETTERS = range(3)

FEATURES = ("length", "entropy", "digits", "capitals", "small", "marks", "transitions",
            "rarest_transition", "class_changes", "covered", "longest_word", "hexadecimal",
            "distinct", "known_format", "assigned", "quoted", "named", "pretended", "named_near",
            "near_covered", "test_path", "code_path", "path_depth", "repeated")
# What :func:`trusted_labels` decides by; a forest that learns from those labels does not see it.
LABELLED_BY = ("length", "digits", "known_format", "assigned", "quoted", "named", "pretended")


def letter_pairs(counts: dict[str, int]) -> tuple[Counter, set[str]]:
    """How often a letter follows an ASCII one, all others together as ``OTHER``, and all letters.

    Candidates are ASCII, so no other pairs are asked for."""
    pairs: Counter = Counter()
    letters: set[str] = set()
    for word, count in counts.items():
        letters.update(word)
        for a, b in zip(word, word[1:]):
            if a < "\x80":
                pairs[a + (b if b < "\x80" else OTHER)] += count
    return pairs, letters


class Language:
    """The words of a corpus and how its letters follow each other."""

    def __init__(self, counts: dict[str, int], pairs: dict[str, int] | None = None,
                 kinds: int = 0) -> None:
        """``pairs`` and ``kinds``: of more words than ``counts`` has, else they are taken from it."""
        if pairs is None:
            pairs, letters = letter_pairs(counts)
            kinds = len(letters)
        self.words = {w for w in counts if len(w) >= 3}
        self.sizes = sorted({len(w) for w in self.words}, reverse=True)
        singles: Counter = Counter()
        for pair, count in pairs.items():
            singles[pair[0]] += count
        kinds = max(1, kinds)
        self.floor = math.log(0.5 / (kinds + 1))
        self.log = {(pair[0], pair[1]): math.log((n + 0.5) / (singles[pair[0]] + 0.5 * kinds))
                    for pair, n in pairs.items()}

    def transitions(self, value: str) -> tuple[float, float]:
        value = value.lower()
        logs = [self.log.get(p, self.floor) for p in zip(value, value[1:])]
        return (sum(logs) / len(logs), min(logs)) if logs else (0.0, 0.0)

    def covered(self, value: str) -> tuple[float, int]:
        """The share of characters that dictionary words cover, longest first from the left."""
        value, at, inside, longest = value.lower(), 0, 0, 0
        while at < len(value):
            for size in self.sizes:
                if size <= len(value) - at and value[at:at + size] in self.words:
                    inside, longest, at = inside + size, max(longest, size), at + size
                    break
            else:
                at += 1
        return inside / max(1, len(value)), longest


def _kind(found: re.Match) -> str:
    return found.lastgroup if found.lastgroup != "glue" else "assigned"


def features(language: Language, text: str, found: re.Match, path: str,
             repeated: bool = False) -> tuple[str, list[float]]:
    """The kind of a candidate and its measures, in the order of :data:`FEATURES`.

    ``repeated``: whether its value is a candidate's more than once in the text.
    """
    kind = _kind(found)
    start, end = found.span(kind)
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    shares = [c / n for c in counts.values()]
    classes = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-"
               for c in value]
    before, after = text[max(0, start - 60):start], text[end:end + 40]
    near = WORD.findall(before)[-3:] + WORD.findall(after)[:3]
    mean, rarest = language.transitions(value)
    covered, longest = language.covered(value)
    around = [language.covered(w)[0] for w in near]
    return kind, [
        float(n), -sum(p * math.log2(p) for p in shares),
        *(classes.count(c) / n for c in "0Aa-"), mean, rarest,
        sum(a != b for a, b in zip(classes, classes[1:])) / n, covered, float(longest),
        float(bool(HEX(value))), len(counts) / n, float(bool(IS_FORMAT(value))),
        float(kind == "assigned"), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(bool(kind == "assigned" and NAMED(found["name"]))),
        float(bool(PRETEND(value) or PRETEND(before[-30:]))),
        float(any(NAMED(w) for w in near)), sum(around) / max(1, len(around)),
        float(bool(TESTS(path))), float(bool(CODE(path))), float(path.count("/")),
        float(repeated),
    ]


class Forest:
    """Decision trees on bootstrap samples, each split the best of a few random measures."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], rng, 0))

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
        share = float(y.mean())
        if depth == DEPTH or len(y) < 2 * LEAF or share in (0.0, 1.0):
            return share
        best = None
        for column in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, column], kind="stable")
            values, ones = x[order, column], np.cumsum(y[order])
            left = np.arange(1, len(y))
            cuts = (values[1:] > values[:-1]) & (left >= LEAF) & (len(y) - left >= LEAF)
            if not cuts.any():
                continue
            p = ones[:-1] / left
            q = (ones[-1] - ones[:-1]) / (len(y) - left)
            impurity = np.where(cuts, left * p * (1 - p) + (len(y) - left) * q * (1 - q), np.inf)
            at = int(np.argmin(impurity))
            if best is None or impurity[at] < best[0]:
                best = (impurity[at], int(column), float(values[at] + values[at + 1]) / 2)
        if best is None:
            return share
        _, column, cut = best
        low = x[:, column] <= cut
        if low.all() or not low.any():
            return share
        return (column, cut, self._grow(x[low], y[low], rng, depth + 1),
                self._grow(x[~low], y[~low], rng, depth + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if not len(rows):
                    continue
                if isinstance(node, float):
                    out[rows] += node
                    continue
                column, cut, left, right = node
                low = x[rows, column] <= cut
                stack += [(left, rows[low]), (right, rows[~low])]
        return out / max(1, len(self.trees))


def learn_language(docs: DataFrame) -> Language:
    """The words of all texts that are at least ``MIN_COUNT`` and a share of ``MIN_SHARE``, and the
    letter pairs of all words. Nothing depends on how the texts are dealt out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for rows in rows_of(batches):
            for (text,) in rows:
                seen.update(WORD.findall((text or "").lower()))
            if len(seen) > HELD:
                yield from _counts(seen)
                seen.clear()
        yield from _counts(seen)

    def _counts(seen: Counter) -> Iterator[pa.RecordBatch]:
        pairs, letters = letter_pairs(seen)
        for what, found in ((WORDS, seen), (PAIRS, pairs), (LETTERS, dict.fromkeys(letters, 1))):
            yield pa.RecordBatch.from_arrays(
                [pa.array([what] * len(found), pa.int32()), pa.array(list(found), pa.string()),
                 pa.array(list(found.values()), pa.int64())], names=["what", "word", "n"])

    counted = written(docs.select("text").mapInArrow(work, "what int, word string, n long")
                      .groupBy("what", "word").agg(F.sum("n").alias("n")), "secret-words")
    sizes = {r[0]: r[1:] for r in counted.groupBy("what").agg(F.sum("n"), F.count("*")).collect()}
    least = max(MIN_COUNT, MIN_SHARE * sizes.get(WORDS, (0, 0))[0])
    words = counted.where((F.col("what") == WORDS) & (F.col("n") >= least) & (F.length("word") >= 3))
    pairs = counted.where(F.col("what") == PAIRS)  # of 26 letters
    return Language({r[0]: r[1] for r in words.select("word", "n").collect()},
                    {r[0]: r[1] for r in pairs.select("word", "n").collect()},
                    sizes.get(LETTERS, (0, 0))[1])


FINDING_SQL = ("doc_id long, start long, length long, kind string, fingerprint string, "
               "x array<double>")


def candidates(docs: DataFrame, language: Language) -> DataFrame:
    """One row a candidate: where it is, a hash of its value, and its measures."""
    shared = docs.sparkSession.sparkContext.broadcast(language)  # of 1 / MIN_SHARE words at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in rows_of(batches):
            out = []
            for doc, path, text in rows:
                own = list(CANDIDATE.finditer(text or ""))
                often = Counter(found[_kind(found)] for found in own)
                for found in own:
                    value = found[_kind(found)]
                    kind, x = features(known, text, found, path or "", often[value] > 1)
                    mark = hashlib.sha256(value.encode()).hexdigest()[:16]
                    out.append((doc, found.start(kind), len(value), kind, mark, x))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                         pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                    names=["doc_id", "start", "length", "kind", "fingerprint", "x"])

    return docs.mapInArrow(work, FINDING_SQL)


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("source").cast("string").alias("path"),
                       F.col("text").cast("string").alias("text"))


def trusted_labels(findings: DataFrame) -> DataFrame:
    """Findings that are plain enough to be labelled without a person looking at them.

    1: a known key format, or 20 or more characters with digits and letters assigned to a telling
    name in quotes. 0: a long string of letters alone, or one that pretends. Others have no label.
    """
    def x(name: str):
        return F.col("x")[FEATURES.index(name)]
    secret = (x("known_format") > 0) | ((x("named") > 0) & (x("quoted") > 0) & (x("length") >= 20)
                                        & (x("digits") > 0) & (x("digits") < 1))
    plain = (x("pretended") > 0) | ((x("digits") == 0) & (x("known_format") == 0)
                                    & (F.col("kind") == "long"))
    return findings.select("fingerprint", F.when(plain, 0).when(secret, 1).alias("label")).where(
        "label IS NOT NULL")


def train(findings: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
          hidden: tuple[str, ...] = ()) -> Forest | None:
    """The forest of labelled findings, as many of either label as the bound allows, by hash.

    ``labels``: ``fingerprint`` and ``label`` 0 or 1; a fingerprint labelled both ways is left out.
    ``hidden`` are measures that the forest must not split by. None where one of the labels is missing.
    """
    clear = (labels.where("label IN (0, 1)").groupBy("fingerprint")
             .agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .where("label = other").select("fingerprint", "label"))
    known = findings.select("fingerprint", "x", "doc_id", "start").join(clear, "fingerprint")
    rows = []
    for label in (0, 1):
        rows += (known.where(F.col("label") == label)
                 .orderBy(F.xxhash64("fingerprint", "doc_id", "start"), "doc_id", "start")
                 .limit(max_labelled // 2).select("x", "label").collect())
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([r[0] for r in rows], float)
    x[:, [FEATURES.index(name) for name in hidden]] = 0.0  # no cut is possible
    return Forest(x, y)


def find_secrets(docs: DataFrame, labels: DataFrame | None = None,
                 max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row a candidate in ``text``: its place and kind, ``score`` and ``is_secret``.

    ``source`` is the path of a document. ``labels`` are findings judged before, by ``fingerprint``;
    without them :func:`trusted_labels` are learnt from, by a forest that sees none of the measures
    that those go by. Where there is nothing to learn from, a candidate counts as a secret with score 1. Null and empty texts have no candidates; null ids and
    paths, repeated rows and very long texts are rows like others. Extra columns are ignored. Values
    are never returned, only 64 bits of a hash of them.
    """
    own = prepared(docs)
    findings = written(candidates(own, learn_language(own)), "secret-candidates")
    forest = (train(findings, trusted_labels(findings), max_labelled, LABELLED_BY) if labels is None
              else train(findings, labels, max_labelled))
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # of TREES trees of bounded depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
            score = shared.value.score(x) if shared.value else np.ones(len(x))
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "kind", "fingerprint")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score, pa.float64())], names=[
                "doc_id", "start", "length", "kind", "fingerprint", "score"])

    scored = findings.mapInArrow(
        work, "doc_id long, start long, length long, kind string, fingerprint string, score double")
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)
