"""Language of a text: words by log frequency per language, unseen words by ever shorter character n-grams.

The model is fitted on a bounded sample of labelled rows: at most about ``ROWS_PER_LANGUAGE`` documents
of each language, chosen by a hash of the id and taken whole. All their words and n-grams count. The model holds
sorted 64-bit hashes and, beside them, counts for the languages that a token came in: a few arrays, which are
collected as Arrow batches and broadcast once. Their size follows the sample, so it is bounded by the number of languages however
large the corpus is. Every whole text is then judged row by row, where it lies.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.llm.common import packed, written

ROWS_PER_LANGUAGE = 2_000
LONGEST = 5
UNKNOWN = "und"
#: Length of the n-grams that show if a word can belong to a learned language.
EVIDENT = 3
#: Share of these that a text in a learned language has at least, and words from which a text is long enough to tell.
LEAST_EVIDENCE = 0.5
FEW_WORDS = 10

_RUN = re.compile(r"[^\W\d_]+")


def words(text: str) -> Counter:
    """Runs of letters in lower case, with their counts."""
    counts = Counter(_RUN.findall(text.lower()))
    for odd in [w for w in counts if not w.isalpha()]:  # signs such as superscripts count as word characters, but are no letters
        n = counts.pop(odd)
        if kept := "".join(filter(str.isalpha, odd)):
            counts[kept] += n
    return counts


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its edges marked."""
    edged = f"<{word}>"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


class Counts:
    """How often tokens came in each language: sorted token hashes, and for each of them its languages and gains.

    A gain is the log of a count over that of a token which never came. Nothing is kept for a token and a
    language it did not come in, so memory follows the counts and not tokens times languages.
    """

    def __init__(self, n_languages: int, keys: np.ndarray, languages: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, self.languages, counts = keys[order], languages[order].astype(np.int32), counts[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.borders = keys[heads], np.append(heads, len(keys))
        self.gains = (np.log(counts + 0.5) - math.log(0.5)).astype(np.float32)
        total = np.bincount(self.languages, counts, n_languages)
        #: Log frequency, in each language, of a token that never came in it.
        self.floor = (math.log(0.5) - np.log(total + 0.5 * (len(self.keys) + 1))).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the numbers of those."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.empty(0, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys
        return known, at[known]

    def gains_of(self, numbers: np.ndarray, n_languages: int) -> np.ndarray:
        """A row of gains for each token number."""
        out = np.zeros((len(numbers), n_languages), np.float32)
        first, n = self.borders[numbers], np.diff(self.borders)[numbers]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)
        out[np.repeat(np.arange(len(numbers)), n), self.languages[at]] = self.gains[at]
        return out


def hashes(tokens: Iterable[str]) -> np.ndarray:
    """XXH64 of the tokens' UTF-8, as Spark's ``xxhash64`` has it."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 42) for t in tokens), np.uint64)


class Model:
    """Counts of words and of n-grams by length, from 1. A few arrays, however many words."""

    def __init__(self, languages: list[str], words: Counts, by_length: list[Counts]):
        self.languages = languages
        self.words = words
        self.by_length = by_length

    def rows(self, wanted: list[str]) -> np.ndarray:
        """For each word a score in every language and, last, the evidence that it belongs to a learned language.

        Scores are the word's own log frequencies, else the mean of its longest known n-grams'; 0 if there are none.
        Evidence is 1 for a known word, else the share of its ``EVIDENT``-grams that are known.
        """
        n = len(self.languages)
        out = np.zeros((len(wanted), n + 1), np.float32)
        known, numbers = self.words.find(hashes(wanted))
        out[known, :n] = self.words.floor + self.words.gains_of(numbers, n)
        out[known, n] = 1
        left = np.flatnonzero(~known)
        unknown = [wanted[i] for i in left]
        scored = np.zeros(len(left), bool)
        for length in range(LONGEST, 0, -1):
            if length != EVIDENT and scored.all():
                continue
            lists = [grams(word, length) for word in unknown]
            owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            table = self.by_length[length - 1]
            met, numbers = table.find(hashes(g for x in lists for g in x))
            if length == EVIDENT:
                out[left, n] = np.bincount(owner[met], minlength=len(lists)) / np.maximum(1, np.bincount(owner, minlength=len(lists)))
            use = ~scored[owner[met]]
            owner, numbers = owner[met][use], numbers[use]
            if not len(owner):
                continue
            sums = np.zeros((len(lists), n), np.float32)
            np.add.at(sums, owner, table.gains_of(numbers, n))
            times = np.bincount(owner, minlength=len(lists))
            fresh = times > 0
            out[left[fresh], :n] = table.floor + sums[fresh] / times[fresh, None]
            scored |= fresh
        return out


class Judge:
    """A model with a memory for the rows of words that came before."""

    PART = 10_000

    def __init__(self, model: Model):
        self.model = model
        width = len(model.languages) + 1
        self.room = max(2 * self.PART, min(200_000, (32 << 20) // (4 * width)))
        self.table = np.empty((self.room, width), np.float32)
        self.memory: dict[str, int] = {}

    def _learn(self, wanted: list[str]) -> None:
        """Rows for words that are not in memory; those from before go if there is no room."""
        for start in range(0, len(wanted), self.PART):
            part = wanted[start : start + self.PART]
            first = len(self.memory)
            self.table[first : first + len(part)] = self.model.rows(part)
            self.memory.update(zip(part, range(first, first + len(part)), strict=True))

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        counts = [words(text) if text else None for text in texts]
        wanted = {word for c in counts if c for word in c if word not in self.memory}
        if len(wanted) + len(self.memory) <= self.room:
            self._learn(list(wanted))
        return [self._judged(c) for c in counts]

    def _judged(self, counts: Counter | None) -> tuple[str, float, float]:
        """Language, its share of the probability, and the evidence that the text is in a learned language at all.

        ``und`` and 0 for null and for texts without a letter; ``und``, 0 and evidence 1 if no language was
        learned. Texts of fewer than ``FEW_WORDS`` words have evidence 1. Of equal scores the first language counts.
        """
        languages = self.model.languages
        if not counts or not languages:
            return UNKNOWN, 0.0, 1.0 if counts else 0.0
        sums = np.zeros(len(languages) + 1)
        items = list(counts)
        for start in range(0, len(items), self.PART):
            part = items[start : start + self.PART]
            lacking = [word for word in part if word not in self.memory]
            if lacking:
                if len(lacking) + len(self.memory) > self.room:
                    self.memory.clear()
                    lacking = part
                self._learn(lacking)
            times = np.fromiter(map(counts.__getitem__, part), float, len(part))
            sums += times @ self.table[np.fromiter(map(self.memory.__getitem__, part), np.int64, len(part))]
        n_words, totals = sum(counts.values()), sums[:-1]
        evidence = 1.0 if n_words < FEW_WORDS else float(sums[-1] / n_words)
        best = int(np.argmax(totals))  # languages are in code-point order: the first of equals
        return languages[best], float(1.0 / np.exp(totals - totals[best]).sum()), evidence


def held_out(id_col: Column) -> Column:
    """True for ids that no model learns from; false for null."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model:
    """Fit on rows with text, id and language that are not held out. Without any, every text is ``und``.

    Rows with a null text, id or language are not learned from; rows that repeat an id are all in the sample or none
    of them. All words and n-grams of the sampled texts count, however long the texts are.
    """
    id_ = F.col(id_col)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & id_.isNotNull() & ~held_out(id_))
    labelled = labelled.select(F.col(lang_col).alias("lang"), F.xxhash64(id_.cast("string")).alias("h"), F.col(text_col).alias("text"))
    shares = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    shares = written(shares.select("lang", F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("n")).alias("share")), "lang-shares")
    sample = labelled.join(shares, "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            rows = [(lang, word, n) for lang, table in seen.items() for word, n in table.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["lang", "token", "n"],
            )

    counted = sample.mapInArrow(count, "lang string, token string, n long").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    counted = written(counted, "lang-words")
    edged = F.concat(F.lit("<"), F.col("token"), F.lit(">"))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(edged))),
            lambda k: F.transform(F.sequence(F.lit(1), F.length(edged) - k + 1), lambda i: F.substring(edged, i, k)),
        )
    )
    languages = sorted(r.lang for r in counted.select("lang").distinct().collect())
    if not languages:
        return Model([], *_no_counts())
    number = F.element_at(F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)]), F.col("lang"))
    pieces = counted.select("lang", "n", F.explode(pieces).alias("token"))
    pieces = pieces.groupBy("lang", "token").agg(F.sum("n").alias("n")).withColumn("length", F.length("token"))

    def collected(table: DataFrame) -> Counts:
        got = table.select(F.xxhash64("token").alias("key"), number.alias("lang"), "n").toArrow()
        columns = [got.column(k).to_numpy() for k in range(3)]
        return Counts(len(languages), columns[0].view(np.uint64), columns[1], columns[2])

    pieces = written(pieces, "lang-grams")
    return Model(languages, collected(counted), [collected(pieces.where(F.col("length") == k)) for k in range(1, LONGEST + 1)])


def _no_counts() -> tuple[Counts, list[Counts]]:
    none = Counts(0, np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return none, [none] * LONGEST


def with_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``_row`` (the whole row of ``docs``), ``lang_pred``, ``score`` and ``evidence``, from the text alone.

    One row per row, also for null ids and repeated rows; null texts and texts without a letter are ``und``, a text
    of any length is judged whole, equal scores go to the first language. An empty table stays empty.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by rows_per_language texts a language
    judges: list[Judge] = []

    @F.pandas_udf("lang_pred string, score double, evidence double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not judges:
            judges.append(Judge(shipped.value))
        for texts in batches:
            found = [row for start in range(0, len(texts), 64) for row in judges[0].judge_all(texts[start : start + 64].tolist())]
            yield pd.DataFrame(found, columns=["lang_pred", "score", "evidence"])

    rows = packed(docs, _text=F.col(f"`{text_col}`")).withColumn("_j", judged.asNondeterministic()("_text"))
    return rows.select("_row", "_j.lang_pred", "_j.score", "_j.evidence")


def of_known_language(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text", least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of ``docs`` whose text can be in a learned language (null text and texts without a letter go).

    Texts of ``FEW_WORDS`` words or more go if their evidence is below ``least_evidence``: words and n-grams that
    no learned language has. ``least`` is for the score. All texts with a letter stay if no language was learned.
    """
    judged = with_language(docs, model, text_col)
    kept = judged.where((F.col("evidence") >= least_evidence) & (F.col("evidence") > 0) & ((F.col("lang_pred") == UNKNOWN) | (F.col("score") >= least)))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
