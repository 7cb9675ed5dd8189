"""Per-document text statistics, and text types learnt from noisy thresholds.

Statistics are exact counts over the whole text. Thresholds on them are treated
as labelling functions that vote for prose, for not prose, or abstain; how
accurate each is in either case is learnt by expectation-maximisation from where
they agree, without labels, over all documents. As a document enters only by
its votes, the corpus is reduced to a count for each pattern of votes, of which
there are at most 3 to the power of the number of functions.

Functions are taken to err independently, so thresholds on the same quantity, or
on ones that go together, are one function. Those that state what is not prose
are anchored: prose is held to hardly ever get their vote, however the rest
turns out. With all other probabilities held above FLOOR, one such vote
outweighs everything else together, so the posterior of a document that the
stated rule calls not prose is never below one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

# Fixed values.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BLANKS = " \t\n\r"
ENDINGS = (".", "!", "?")

COUNTS = ("n_words", "n_chars", "n_symbols", "n_common", "n_lines", "n_ended")
COMMON_WORDS_AT_ONCE = 500_000
MAX_KNOWN_WORDS = 300_000
COMMON = COUNTS.index("n_common")

#: Least probability of a vote or a class, and that of an anchored function's vote against prose, given prose.
FLOOR, ANCHOR = 0.01, 1e-12

PROSE, NOT_PROSE, ABSTAIN = 0, 1, 2

_WORD = re.compile(r"[^ \t\n\r]+")


class _Common(dict):
    """Whether a word as written is a common one, remembered."""

    def __init__(self, common: frozenset[str]):
        super().__init__()
        self.common = common

    def __missing__(self, word: str) -> bool:
        known = word.strip(PUNCTUATION).lower() in self.common
        if len(self) < MAX_KNOWN_WORDS:
            self[word] = known
        return known


def counts(text: str | None, common: _Common) -> tuple[int, ...]:
    """COUNTS of one text; a null text counts as an empty one, which has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    found = _WORD.findall(text)
    raw = text.encode()
    lines = ended = 0
    for line in text.split("\n"):
        bare = line.rstrip(" \t\r")
        if bare:
            lines += 1
            ended += bare.endswith(ENDINGS)
    return (
        len(found),
        len(text) - sum(map(text.count, BLANKS)),
        len(raw) - len(raw.translate(None, PUNCTUATION.encode())),
        sum(map(common.__getitem__, found)),
        lines,
        ended,
    )


def _word_blocks(common_words: DataFrame, word: str) -> Iterator[frozenset[str]]:
    """The distinct words in blocks, of which there is at least one."""
    rows = common_words.select(word).where(F.col(word).isNotNull()).distinct().toLocalIterator()
    while block := frozenset(r[0] for r in islice(rows, COMMON_WORDS_AT_ONCE)):
        yield block
        if len(block) < COMMON_WORDS_AT_ONCE:
            return
    yield frozenset()


def text_counts(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """``key`` and COUNTS of every row.

    Words are runs of characters other than blank, tab, LF and CR; n_chars is
    their total length in code points; n_symbols counts ASCII punctuation;
    n_common the words that are in ``common_words`` once that punctuation is
    stripped at both ends and they are lower-cased; n_lines the lines that are
    not empty without blanks, tabs and CR at their right; n_ended those that end
    in ``.``, ``!`` or ``?``. Null and empty texts count 0 throughout. Null
    words in ``common_words`` are ignored; with no words n_common is 0. One row
    out for each row in, without a shuffle.

    The word list is sent to every worker, in blocks of COMMON_WORDS_AT_ONCE,
    which a batch of texts goes through one after another.
    """
    sent = [documents.sparkSession.sparkContext.broadcast(block) for block in _word_blocks(common_words, word)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = _Common(sent[0].value)
        for batch in batches:
            rows = np.array([counts(t.as_py(), common) for t in batch.column(1)], dtype=np.int64).reshape(-1, len(COUNTS))
            for block in sent[1:]:
                more = _Common(block.value)
                rows[:, COMMON] += [sum(map(more.__getitem__, _WORD.findall(t.as_py() or ""))) for t in batch.column(1)]
                vars(block).pop("_value", None)  # the worker keeps one of them at a time
            columns = [pa.array(rows[:, i]) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *COUNTS])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


@dataclass(frozen=True)
class Vote:
    """A labelling function: a condition for each side; where neither holds (or is null) it abstains. An anchored one defines what is not prose."""

    name: str
    not_prose: Column
    prose: Column
    anchored: bool = False

    def cast_as(self) -> Column:
        return F.when(self.not_prose, NOT_PROSE).when(self.prose, PROSE).otherwise(ABSTAIN)


def votes() -> list[Vote]:
    """Thresholds on the counts, compared in whole numbers: the clauses of the stated rule, and the words of a line."""
    w, c, s, k, n, e = (F.col(x) for x in COUNTS)
    clauses = {"word_length": c >= 10 * w, "symbols": 4 * s >= c, "plain_words": (100 * k < 15 * w) & (5 * e < n)}
    return [*[Vote(name, clause, ~clause, anchored=True) for name, clause in clauses.items()], Vote("line_words", w < 4 * n, w >= 10 * n)]


def stated_rule() -> Column:
    """Not prose by the fixed thresholds; documents without a word are undecided (null)."""
    w, c, s, k, n, e = (F.col(x) for x in COUNTS)
    rule = (c >= 10 * w) | (4 * s >= c) | ((100 * k < 15 * w) & (5 * e < n))
    return F.when(w > 0, rule)


@dataclass
class VoteModel:
    """Probabilities of each vote, given prose or not; shape (class, function, vote)."""

    prior: np.ndarray
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(not prose) of each line of votes."""
        score = np.log(self.prior)[None, :] + np.zeros((len(patterns), 2))
        for f in range(patterns.shape[1]):
            score += np.log(self.table[:, f, :][:, patterns[:, f]]).T
        score -= score.max(axis=1, keepdims=True)
        odds = np.exp(score)
        return odds[:, NOT_PROSE] / odds.sum(axis=1)


def _held(p: np.ndarray) -> np.ndarray:
    """Probabilities along the last axis, none below FLOOR."""
    return FLOOR + (1 - p.shape[-1] * FLOOR) * p / p.sum(axis=-1, keepdims=True)


def learn(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100, anchored: Sequence[int] = ()) -> VoteModel:
    """Expectation-maximisation over weighted patterns of votes; deterministic.

    It starts from every function being right in seven of ten votes, which
    settles which of the two classes is which. Without any pattern the start is
    returned. Functions in ``anchored`` keep ANCHOR for a vote against prose.
    """
    functions, anchors = patterns.shape[1], list(anchored)
    table = np.full((2, functions, 3), 0.3)
    table[PROSE, :, PROSE] = table[NOT_PROSE, :, NOT_PROSE] = 0.7
    table[:, :, ABSTAIN] = 0.5
    model = VoteModel(np.array([0.5, 0.5]), _held(table))
    for number in range(rounds + 1 if len(patterns) else 1):
        if number:
            other = model.posterior(patterns) * weights
            shares = np.stack([weights - other, other])
            counted = np.stack([shares @ (patterns == vote) for vote in (PROSE, NOT_PROSE, ABSTAIN)], axis=2) + 1e-9
            model = VoteModel(_held(shares.sum(axis=1) + 1e-9), _held(counted))
        model.table[PROSE, anchors, NOT_PROSE] = ANCHOR
    return model


def text_types(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """``key``, COUNTS, the votes, ``p_not_prose`` and ``text_type`` of every row.

    ``text_type`` is ``prose``, ``not_prose``, or ``empty`` for a document
    without a word, which takes no part in learning and has a null posterior.
    Counts are made once, in one pass over the texts, and kept in the shared
    folder; only the counts of vote patterns reach the driver.
    """
    rows = text_counts(documents, common_words, key, text, word)
    functions = votes()
    names = [f"vote_{v.name}" for v in functions]
    voted = cut_lineage(rows.select(key, *COUNTS, *[v.cast_as().alias(n) for v, n in zip(functions, names)]))
    seen = voted.where(F.col("n_words") > 0).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = np.array([r[:-1] for r in map(tuple, seen)], dtype=np.int64).reshape(-1, len(names))
    anchored = [i for i, v in enumerate(functions) if v.anchored]
    model = learn(patterns, np.array([r.n for r in seen], dtype=float), anchored=anchored)
    # log-odds add up vote by vote, so the posterior is an expression and needs no join
    odds = np.log(model.prior[NOT_PROSE] / model.prior[PROSE])
    score = F.lit(float(odds))
    ratios = np.log(model.table[NOT_PROSE] / model.table[PROSE])
    for n, name in enumerate(names):
        score = score + F.element_at(F.array(*[F.lit(float(x)) for x in ratios[n]]), F.col(name) + 1)
    some = F.col("n_words") > 0
    p = F.when(some, 1 / (1 + F.exp(-score)))
    kind = F.when(~some, "empty").when(score >= 0, "not_prose").otherwise("prose")
    return voted.withColumn("p_not_prose", p).withColumn("text_type", kind)
