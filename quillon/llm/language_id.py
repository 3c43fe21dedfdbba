"""Language identification, words first: a known word scores by its log frequency in each language; an unseen one by
its character n-grams, the longest that are known.

Words and n-grams are counted over all training texts. What a scorer carries is bounded: the most frequent ENTRIES
words, and as many n-grams of each length.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import slices, translated, words, written

#: Words, and n-grams of one length, that a model holds at most, counted once for each language that has them.
ENTRIES = 1 << 17
#: The longest n-gram, in code points; a word's ends count as one each.
LONGEST = 5
#: Words of more code points are never known by themselves.
WORD_LENGTH = 40
#: What is added to each count.
SMOOTHING = 0.5
#: Words that a worker adds up before it hands their counts on.
HELD = 1 << 18
#: Marks of a word's start and end in its n-grams; no letters.
START, END = "^", "$"

LETTERS = regex.compile(r"\p{L}+")

#: ASCII letters stay (A-Z in lower case), other ASCII is a space; bytes of 128 and more stay.
_ASCII = np.full(256, 32, np.uint8)
_ASCII[0x61:0x7B] = np.arange(0x61, 0x7B)
_ASCII[0x41:0x5B] = np.arange(0x61, 0x7B)
_ASCII[0x80:] = np.arange(0x80, 0x100)


def letter_runs(texts: pa.Array) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """(words of each distinct piece, piece at each place, offsets of the texts): pieces are what lies between ASCII
    characters other than letters, words their runs of letters in lower case."""
    dictionary, codes, offsets = words(translated(texts, _ASCII), lower=False)
    plain = np.asarray(pc.string_is_ascii(dictionary), dtype=bool)
    pieces = [[p] * bool(p) if ascii_only else LETTERS.findall(p.lower()) for p, ascii_only in zip(dictionary.to_pylist(), plain, strict=True)]
    return pieces, codes, offsets


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word between its marks."""
    marked = START + word + END
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Level:
    """Log frequencies of the entries of one kind (words, or n-grams of one length) in each language."""

    unseen: np.ndarray
    places: dict[str, int] = field(default_factory=dict)
    logs: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple[str, int, int]], totals: np.ndarray) -> Level:
        """From (entry, language, count) and all languages' sums of counts, entries left out of ``rows`` included."""
        places: dict[str, int] = {}
        for entry, _, _ in rows:
            places.setdefault(entry, len(places))
        norm = np.log(totals + SMOOTHING * (len(places) + 1))
        logs = np.full((len(places), len(totals)), np.log(SMOOTHING))
        for entry, language, n in rows:
            logs[places[entry], language] = np.log(n + SMOOTHING)
        return Level(np.log(SMOOTHING) - norm, places, logs - norm)


def _places(level: Level, entries: list[str]) -> np.ndarray:
    """Rows of the entries in a level, -1 for unknown ones."""
    return np.fromiter(map(level.places.get, entries, repeat(-1)), np.int64, len(entries))


@dataclass
class LanguageModel:
    """languages in order, log shares of the training documents, the words, and n-grams from the longest to single
    characters."""

    languages: list[str]
    priors: np.ndarray
    words: Level | None
    grams: list[tuple[int, Level]]

    def words_scores(self, found: list[str]) -> np.ndarray:
        """Log frequencies (words x languages). Unseen words back off to n-grams, shorter and shorter until one is known,
        and then score by the mean of those known; zeros if none is, for such a word says nothing."""
        out = np.zeros((len(found), len(self.languages)))
        places = _places(self.words, found)
        out[places >= 0] = self.words.logs[places[places >= 0]]
        unseen = np.flatnonzero(places < 0)
        for n, level in self.grams:
            if not len(unseen):
                break
            marked = [START + found[i] + END for i in unseen.tolist()]
            counts = np.fromiter((max(len(m) - n + 1, 0) for m in marked), np.int64, len(marked))
            at = _places(level, [m[i : i + n] for m in marked for i in range(len(m) - n + 1)])
            owner = np.repeat(np.arange(len(marked)), counts)[at >= 0]
            at = at[at >= 0]
            known = np.bincount(owner, minlength=len(marked))
            some = known > 0
            for k in range(out.shape[1]):
                out[unseen[some], k] = (np.bincount(owner, weights=level.logs[at, k], minlength=len(marked)) / np.maximum(known, 1))[some]
            unseen = unseen[~some]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(language, its posterior probability) of each text."""
        pieces, codes, offsets = letter_runs(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        scores = self.words_scores([w for p in pieces for w in p])
        ends = np.cumsum(sizes)
        total = np.empty((len(texts), len(self.languages)))
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[codes])])[offsets])
        for k in range(len(self.languages)):  # one language at a time: memory of a place, not of places x languages
            run = np.concatenate([[0], np.cumsum(scores[:, k])])
            total[:, k] = sums(run[ends] - run[ends - sizes]) + self.priors[k]
        speaks = sums(sizes) > 0
        best = total.argmax(1)
        p = 1 / np.exp(total - total[np.arange(len(total)), best][:, None]).sum(1)
        return [self.languages[b] if s else "und" for b, s in zip(best, speaks, strict=True)], np.where(speaks, p, 0.0)


def _counted(docs: DataFrame) -> DataFrame:
    """(entry, lang, n): how often each word occurs in the texts of each language."""

    def count(batches):
        held: dict[tuple[str, str], int] = {}

        def out():
            keys = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], names=["entry", "lang", "n"])
            held.clear()
            return batch

        for batch in slices(batches, "text"):
            by_lang = pc.dictionary_encode(batch["lang"])
            which = np.asarray(by_lang.indices)
            for k, lang in enumerate(by_lang.dictionary.to_pylist()):
                pieces, codes, _ = letter_runs(batch["text"].filter(pa.array(which == k)))
                for found, n in zip(pieces, np.bincount(codes, minlength=len(pieces)).tolist(), strict=True):
                    for w in found:
                        held[w, lang] = held.get((w, lang), 0) + n
            if len(held) >= HELD:
                yield out()
        yield out()

    return docs.mapInArrow(count, "entry string, lang string, n long").groupBy("entry", "lang").agg(F.sum("n").alias("n"))


def _gram_counts(counts: DataFrame, n: int) -> DataFrame:
    """(entry, lang, n) of the n-grams of all counted words, each as often as its words occur."""
    marked = counts.withColumn("m", F.concat(F.lit(START), F.col("entry"), F.lit(END))).filter(F.char_length("m") >= n)
    starts = F.sequence(F.lit(1), F.char_length("m") - (n - 1))
    spelt = marked.select(F.explode(F.transform(starts, lambda i: F.substring(F.col("m"), i, F.lit(n)))).alias("entry"), "lang", "n")
    return spelt.groupBy("entry", "lang").agg(F.sum("n").alias("n"))


def _level(counts: DataFrame, languages: list[str], entries: int) -> Level:
    """The most frequent entries, at most ``entries`` rows of (entry, lang): those at or above a count that a histogram
    of rounded logarithms gives (a few hundred numbers), so nothing is sorted."""
    by_entry = counts.groupBy("entry").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("langs"))
    bin_of = lambda c: F.floor(F.log2(c) * 8).cast("int")
    sizes = sorted(by_entry.groupBy(bin_of(F.col("all")).alias("bin")).agg(F.sum("langs")).collect(), reverse=True)
    held, least = 0, None
    for b, n in sizes:
        if held + n > entries:
            break
        held, least = held + n, b
    number = {lang: i for i, lang in enumerate(languages)}
    totals = np.zeros(len(languages))
    for lang, n in counts.groupBy("lang").agg(F.sum("n")).collect():  # a row for each language
        totals[number[lang]] = n
    if least is None:
        return Level.of([], totals)
    chosen = counts.join(by_entry.filter(bin_of(F.col("all")) >= least).select("entry"), "entry").select("entry", "lang", "n").toArrow()  # at most `entries` rows of short strings
    rows = sorted((e, number[lang], n) for e, lang, n in zip(*(chosen[c].to_pylist() for c in ("entry", "lang", "n")), strict=True))
    return Level.of(rows, totals)


def fit(docs: DataFrame, learns: Column, text_col: str = "text", lang_col: str = "lang", entries: int = ENTRIES, longest: int = LONGEST) -> LanguageModel:
    """A model of the rows for which ``learns`` holds and the language is known.

    Null and empty texts add nothing but to their language's share of documents; repeated rows count as often as they
    occur. Without any such row no language is learnt, and everything is ``und``.
    """
    train = docs.filter(learns & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = sorted(train.groupBy("lang").count().collect())  # a row for each language
    if not shares:
        return LanguageModel([], np.zeros(0), None, [])
    languages = [lang for lang, _ in shares]
    counts = written(_counted(train), "words")
    known = _level(counts.filter(F.char_length("entry") <= WORD_LENGTH), languages, entries)
    levels = [(n, _level(written(_gram_counts(counts, n), "grams"), languages, entries)) for n in range(longest, 0, -1)]
    seen = np.array([n for _, n in shares], dtype=float)
    return LanguageModel(languages, np.log(seen / seen.sum()), known, levels)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1, the model's probability of that language), from the whole text
    alone; columns with these names are replaced.

    Null texts and texts without a letter are ``und`` with score 0. Ties go to the language that sorts first; a text
    none of whose characters were seen in training gets the most frequent language of the training rows.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    names = [f.name for f in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ENTRIES strings for words and for each length of n-grams

    def add(batches):
        for batch in slices(batches, text_col):
            languages, p = shared.value.predict(batch[text_col])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(languages, pa.string()), pa.array(p)], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(add, T.StructType([*keep, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
