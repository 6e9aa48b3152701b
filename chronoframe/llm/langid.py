"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. A word that no language knows
is scored by its character n-grams, longest first: the word is read from the left and at
each place the longest known n-gram is taken, down to single characters. What a language
lacks has the same least frequency in all of them, so that one learned from little text
is not favoured by it.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import Scratch, bucket, held

#: Characters of the different texts that the model is fitted on, all languages together (expected; a hash of
#: the text chooses, and each language has one text at least). It bounds the model, of which nothing is cut.
SAMPLE_CHARS = 4_000_000
GRAMS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Texts that are scored at a time, and words a worker remembers the backoff of: they change the cost only.
TEXTS, REMEMBERED, REMEMBERED_CHARS = 200, 50_000, 64


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case."""
    found = LETTERS.findall(text.lower())
    if text.isascii():
        return found
    return [v for w in found for v in ((w,) if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def grams(word: str, n: int):
    w = f" {word} "
    return (w[i : i + n] for i in range(len(w) - n + 1))


def _count_batches(batches):
    """Counts of words (under n = 0) and n-grams by language within a partition."""
    kept: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            kept.setdefault(lang, Counter()).update(words(text))
    for lang, found in kept.items():
        parts: dict[int, Counter] = {0: found, **{n: Counter() for n in GRAMS}}
        for w, c in found.items():
            for n in GRAMS:
                for g in grams(w, n):
                    parts[n][g] += c
        rows = [(lang, n, item, c) for n, part in parts.items() for item, c in part.items()]
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 50_000]), (pa.string(), pa.int32(), pa.string(), pa.int64()))], ["lang", "n", "item", "c"])


class Model:
    """Log frequencies by item and language: words under n = 0, n-grams under their length.

    Sparse: an item's row holds only the languages that have it, as what their log
    frequency is above the least one. All scores are sums of these, up to a number that
    is the same for all languages.
    """

    def __init__(self, counts: list[tuple]):
        totals, sizes = Counter(), Counter()
        for lang, n, _, c in counts:
            totals[lang, n] += c
            sizes[lang, n] += 1
        self.langs = sorted({lang for lang, *_ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        room = {key: math.log(total + sizes[key] + 1) for key, total in totals.items()}
        least = {n: max((x for (_, k), x in room.items() if k == n), default=0.0) for n in (0, *GRAMS)}
        self.index: dict[int, dict[str, int]] = {n: {} for n in (0, *GRAMS)}
        rows = sorted((n, item, at[lang], math.log(c + 1) - room[lang, n] + least[n]) for lang, n, item, c in counts)
        starts = []
        for i, (n, item, _, _) in enumerate(rows):
            if item not in self.index[n]:
                self.index[n][item] = len(starts)
                starts.append(i)
        self.start = np.array([*starts, len(rows)], np.int64)
        self.lang = np.array([x[2] for x in rows], np.int64)
        self.above = np.array([x[3] for x in rows], np.float64)
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def entries(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number within ids, place in lang and above) of all entries of some rows."""
        size = self.start[ids + 1] - self.start[ids]
        own = np.repeat(np.arange(len(ids)), size)
        return own, np.arange(len(own)) + np.repeat(self.start[ids] - np.cumsum(size) + size, size)

    def pieces(self, w: str) -> tuple[list[int], int]:
        """Rows of the longest known n-grams that cover a word, and the steps that takes."""
        s, at, ids, steps = f" {w} ", 0, [], 0
        while at < len(s):
            for n in GRAMS:
                row = self.index[n].get(s[at : at + n]) if at + n <= len(s) else None
                if row is not None:
                    ids.append(row)
                    at += n
                    break
            else:
                at += 1  # no language knows the character
            steps += 1
        return ids, steps

    def backoff(self, words: list[str]) -> None:
        """Remembers the scores of unseen words: the sum over their pieces, then as one word's worth."""
        cut = [self.pieces(w) for w in words]
        rows = np.array([i for ids, _ in cut for i in ids], np.int64)
        of = np.repeat(np.arange(len(cut)), [len(ids) for ids, _ in cut])
        own, place = self.entries(rows)
        size = len(self.langs)
        total = np.bincount(of[own] * size + self.lang[place], self.above[place], len(cut) * size).reshape(-1, size)
        self.known.update(zip(words, total / np.array([steps for _, steps in cut])[:, None]))

    def word(self, w: str) -> np.ndarray:
        """Scores of a word by language."""
        if (row := self.index[0].get(w)) is None:
            self.backoff([w])
            return self.known[w]
        _, place = self.entries(np.array([row]))
        return np.bincount(self.lang[place], self.above[place], len(self.langs))

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability of it) of each text. Ties go to the language that sorts first."""
        size = len(self.langs)
        if not size:
            return [(UNKNOWN, 0.0)] * len(texts)
        total = np.zeros((len(texts), size))
        seen, rows, times, of, unseen, others, other_of = [], [], [], [], [], [], []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        get = self.index[0].get
        for i, text in enumerate(texts):
            found = Counter(words(text or ""))
            seen.append(bool(found))
            for w, c in found.items():
                if (row := get(w)) is not None:
                    rows.append(row)
                    times.append(c)
                    of.append(i)
                else:
                    unseen.append(w)
                    others.append(c)
                    other_of.append(i)
        if rows:
            of, times = np.array(of), np.array(times, np.float64)
            own, place = self.entries(np.array(rows))
            total += np.bincount(of[own] * size + self.lang[place], times[own] * self.above[place], total.size).reshape(total.shape)
        if unseen:
            self.backoff(list({w for w in unseen if w not in self.known}))
            vectors = np.array([self.known[w] for w in unseen])
            np.add.at(total, np.array(other_of), vectors * np.array(others, np.float64)[:, None])
            for w in {w for w in unseen if len(w) > REMEMBERED_CHARS}:
                del self.known[w]
        best = total.argmax(axis=1)
        score = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700.0)).sum(axis=1)
        return [(self.langs[b], x) if ok else (UNKNOWN, 0.0) for ok, b, x in zip(seen, best.tolist(), score.tolist())]


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from the rows of docs(text, lang) whose lang and text are not null.

    Each language has an equal share of sample_chars; one with more is thinned to about so
    much by a hash of the text, to one text at least, and equal texts of a language count
    once. All languages, words and n-grams of the sample are learned. No usable row: a
    model of no language.
    """
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    rows = docs.select("lang", "text", place.alias("place")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text").cast("bigint")).alias("chars"), F.min("place").alias("least")).collect()
    if not sizes:
        return Model([])
    room = sample_chars / len(sizes)
    last = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["least"], int((1 << 30) * min(1.0, room / max(1, r["chars"])))))])
    sample = rows.where(F.col("place") <= F.try_element_at(last, "lang")).select("lang", "text").distinct()
    counts = sample.mapInArrow(_count_batches, "lang string, n int, item string, c bigint").groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    found = Scratch(docs.sparkSession).keep(counts).toArrow()
    return Model(list(zip(*(c.to_pylist() for c in found.columns))))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs, which keep their columns but for older ones of these names.

    Null texts and texts without a letter get `und` and 0. Only the named text is read.
    """
    spark = docs.sparkSession
    sent, key = spark.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double"])

    def run(batches):
        own = held(key, lambda: pickle.loads(sent.value))
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                got = own.predict_all(part.column(names.index(text)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned where crc32(doc_id as text) mod 4 is not 2.

    A null id counts as empty text and is not held out. Repeated rows give equal rows, a
    very long text is scored whole, and an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", bucket("doc_id", 4) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
