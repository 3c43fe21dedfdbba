"""Brown class-based n-grams: words are clustered by exchange, texts scored by class transitions and word emissions.

1. One scan cuts the corpus into blocks. A block becomes its dictionary, its documents as codes into it, and the
   counts of neighbouring words in its training documents. All of this is written.
2. The dictionaries' words meet in buckets, where each distinct word gets a number and its count over the training
   documents: all words, none cut off.
3. Exchange clustering. In a round the words' classes go to the blocks, where the counts of neighbouring words become
   counts of each word with the classes of its left and right neighbours; they meet by word. They give the counts of
   class bigrams, hence the log likelihood of the class bigram model, and each word moves to the class under whose
   neighbours its own are likeliest. Only the counts of class bigrams pass through the driver. The rounds end when the
   likelihood rises by less than LEAST_RISE, and the classes with the highest one are taken: it never falls.
4. Each block gets the count and class of its words, and each document becomes counts of class transitions and a sum
   of word emissions. Transitions are summed over the training documents and smoothed; documents are scored by them.

P(word | previous) = (1 - u) P(class | previous class) count(word) / count(class) for words seen in training. u, the
share of unseen words after that class, follows from words seen once (Good and Turing); all unseen words are one event.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.blocks import Block, Index, blocks, by_bucket, pack_words, squeeze, unpack_words, unsqueeze
from quillon.llm.common import parallelism, tasks_for, words, written

CLASSES = 32
#: The class of a text's border, in the counts of neighbours.
EDGE = CLASSES
#: Neighbours of a word: left classes and the border, then right ones.
SIDES = 2 * (CLASSES + 1)
#: Rounds of exchange at most, and the share by which the likelihood must rise for another one.
ROUNDS, LEAST_RISE = 5, 0.002
#: Strength of the smoothing, in observations: of transitions and of the share of unseen words.
MU, KAPPA = 50.0, 50.0
BORDER, UNSEEN = CLASSES, CLASSES + 1
#: A document's states: words by class, its border, unseen words, and words seen once by class.
STATES = 2 * CLASSES + 2
#: Words whose counts a worker spreads out at a time.
CHUNK = 20_000

#: Rows of a coded corpus: of a block (or of a word bucket, with block 0) and a kind.
CODED = "block long, kind int, bucket int, ids array<long>, data binary, words binary"
DICTIONARY, DOCUMENTS, NEIGHBOURS = 0, 1, 2
#: Rows of the vocabulary: the places that a bucket's words have in a block, and the words with counts.
PLACES, WORDS = 3, 4


def _rows(found: list[tuple]) -> pa.RecordBatch:
    """A batch of CODED rows."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
    columns = list(zip(*found, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "kind", "bucket", "ids", "data", "words"])


def _by_row(batches):
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in ("block", "kind", "bucket", "ids", "data", "words")), strict=True)


def _together(df: DataFrame, buckets: int, by: str, last: str) -> DataFrame:
    """All rows of one value of ``by`` behind one another, in the order of ``last``."""
    return df.repartition(buckets, by).sortWithinPartitions(by, last)


def _read(block: Block, part: pa.RecordBatch) -> None:
    """Notes the slice's documents as codes into the block's index."""
    dictionary, codes, at = words(part["text"])
    place = np.fromiter((block.index[w.encode()] for w in dictionary.to_pylist()), np.int64, len(dictionary))
    block.kept.append((part["id"].to_pylist(), np.asarray(part["train"], dtype=bool), at, (place[codes] if len(codes) else codes).astype(np.int32)))


def _neighbours(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left place, right place, count) of the block's training documents, in order; the border's place is the index's
    length."""
    edge = len(block.index)
    keys = []
    for _, train, at, codes in block.kept:
        seq = np.full(len(codes) + len(train), edge, np.int64)  # each document and the border after it
        last = np.cumsum(np.diff(at) + 1) - 1
        inner = np.ones(len(seq), bool)
        inner[last] = False
        seq[inner] = codes
        before = np.append(edge, seq[:-1])
        use = np.repeat(train, np.diff(at) + 1)
        keys.append(before[use] * (edge + 1) + seq[use])
    found, counts = np.unique(np.concatenate(keys), return_counts=True)
    return found // (edge + 1), found % (edge + 1), counts


def coded_corpus(rows: DataFrame, buckets: int) -> DataFrame:
    """The blocks of rows (id, text, train) as CODED rows, written."""

    def code(batches):
        first = TaskContext.get().partitionId() << 32  # the table is written once: its numbers hold
        for number, block in enumerate(blocks(batches, _read), first):
            names = list(block.index)
            total = np.zeros(len(names), np.int64)
            for ids, train, at, codes in block.kept:
                total += np.bincount(codes[np.repeat(train, np.diff(at))], minlength=len(names))
                marked = np.diff(at) << 1 | train
                yield _rows(
                    [
                        (number, DOCUMENTS, None, ids[a : a + 512], squeeze(marked[a : a + 512], codes[at[a] : at[min(a + 512, len(marked))]]), None)
                        for a in range(0, len(marked), 512)
                    ]
                )
            left, right, counts = _neighbours(block)
            if len(left):
                yield _rows([(number, NEIGHBOURS, None, [], squeeze(left, right, counts), None)])
            yield _rows([(number, DICTIONARY, b, [], squeeze(at, total[at]), pack_words([names[i] for i in at.tolist()])) for b, at in by_bucket(names, buckets)])

    return written(rows.mapInArrow(code, CODED), "coded")


def first_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def vocabulary(coded: DataFrame, buckets: int) -> DataFrame:
    """PLACES rows (places in the block, numbers in the bucket) and a WORDS row of each bucket (counts, first classes;
    the words), written."""

    def number(batches):
        bucket, index, totals = None, Index(), []

        def done():
            if bucket is not None:
                n = np.zeros(len(index), np.int64)
                for j, counts in totals:
                    n[j] += counts.astype(np.int64)
                yield _rows([(0, WORDS, bucket, [], squeeze(n & 0xFFFFFFFF, n >> 32, [first_class(w) for w in index]), pack_words(list(index)))])

        for block, _, b, _, data, packed in _by_row(batches):
            if b != bucket:
                yield from done()
                bucket, index, totals = b, Index(), []
            places, counts = unsqueeze(data)
            j = np.array([index[w] for w in unpack_words(packed)], np.int64)
            totals.append((j, counts))
            yield _rows([(block, PLACES, b, [], squeeze(places, j), None)])
        yield from done()

    return written(_together(coded.filter(F.col("kind") == DICTIONARY), buckets, "bucket", "block").mapInArrow(number, CODED), "vocabulary")


def _counts_classes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, classes = (x.astype(np.int64) for x in unsqueeze(data))
    return low | high << 32, classes


def _placed(vocab: DataFrame, known: DataFrame, buckets: int) -> DataFrame:
    """For each block and bucket the places, numbers, counts and classes of its words (kind DICTIONARY)."""

    def place(batches):
        n = classes = None
        for block, kind, bucket, _, data, _ in _by_row(batches):
            if kind == WORDS:
                n, classes = _counts_classes(data)
            else:
                places, j = unsqueeze(data)
                yield _rows([(block, DICTIONARY, bucket, [], squeeze(places, j, np.minimum(n[j], 2), classes[j], n[j] & 0xFFFFFFFF, n[j] >> 32), None)])

    rows = vocab.filter(F.col("kind") == PLACES).unionByName(known)
    return rows.withColumn("__o", -F.col("kind")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "__o").drop("__o").mapInArrow(place, CODED)


def _contexts(batches):
    """For each block and bucket, of its words the counts of neighbours' classes: numbers, how many cells, cells, counts."""
    block, held = None, []
    for number, kind, bucket, _, data, _ in _by_row(batches):
        if number != block:
            block, held = number, []
        if kind == DICTIONARY:
            places, j, _, classes, _, _ = unsqueeze(data)
            held.append((bucket, places.astype(np.int64), j, classes))
            continue
        left, right, counts = (x.astype(np.int64) for x in unsqueeze(data))
        size = sum(len(h[1]) for h in held)
        of = np.full(size + 1, EDGE, np.int64)
        own, home = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for k, (_, places, j, classes) in enumerate(held):
            of[places], own[places], home[places] = classes, j, k
        order = np.argsort(right, kind="stable")
        cells = []
        for a in range(0, size, CHUNK):
            b = min(a + CHUNK, size)
            x, y = np.searchsorted(left, [a, b])
            p, q = np.searchsorted(right[order], [a, b])
            some = order[p:q]
            key = np.concatenate([(left[x:y] - a) * SIDES + CLASSES + 1 + of[right[x:y]], (right[some] - a) * SIDES + of[left[some]]])
            dense = np.bincount(key, np.concatenate([counts[x:y], counts[some]]), (b - a) * SIDES)
            used = np.flatnonzero(dense)
            cells.append((used // SIDES + a, used % SIDES, dense[used].astype(np.int64)))
        place, cell, n = (np.concatenate(c) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 3
        order = np.argsort(home[place], kind="stable")
        place, cell, n = place[order], cell[order], n[order]
        cut = np.searchsorted(home[place], np.arange(len(held) + 1))
        yield _rows([(block, NEIGHBOURS, h[0], [], squeeze(own[place[a:b]], cell[a:b], n[a:b]), None) for h, a, b in zip(held, cut[:-1], cut[1:], strict=True) if b > a])


def _summed(batches):
    """Of each bucket the words' classes and counts, and the sums of their neighbours' classes."""
    bucket, data, total = None, None, None

    def done():
        if bucket is not None:
            used = np.flatnonzero(total)
            n = total[used]
            yield _rows([(0, WORDS, bucket, [], data, squeeze(used // SIDES, used % SIDES, n & 0xFFFFFFFF, n >> 32))])

    for _, kind, b, _, packed, _ in _by_row(batches):
        if b != bucket:
            yield from done()
            bucket = b
        if kind == WORDS:
            data = packed
            total = np.zeros(len(_counts_classes(packed)[0]) * SIDES, np.int64)
        else:
            j, cell, n = (x.astype(np.int64) for x in unsqueeze(packed))
            total[j * SIDES + cell] += n  # a word's cells stand once in a block
    yield from done()


def _cells(row: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    j, cell, low, high = (x.astype(np.int64) for x in unsqueeze(row))
    return j, cell, low | high << 32


def class_bigrams(summed: DataFrame) -> np.ndarray:
    """Counts of class bigrams, (CLASSES + 1) x (CLASSES + 1) with the border; without empty documents."""

    def count(batches):
        total = np.zeros((CLASSES + 1) ** 2, np.int64)
        for _, _, _, _, data, cells in _by_row(batches):
            _, classes = _counts_classes(data)
            j, cell, n = _cells(cells)
            after = cell <= EDGE  # a left neighbour, and the word's own class
            np.add.at(total, cell[after] * (CLASSES + 1) + classes[j[after]], n[after])
            last = cell == SIDES - 1  # the border after a word
            np.add.at(total, classes[j[last]] * (CLASSES + 1) + EDGE, n[last])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["cell", "n"])

    out = np.zeros((CLASSES + 1) ** 2)
    for cell, n in summed.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # (CLASSES + 1)^2
        out[cell] = n
    return out.reshape(CLASSES + 1, CLASSES + 1)


def likelihood(bigrams: np.ndarray) -> float:
    """The classes' part of the log likelihood of the class bigram model: N(c, d) against N(c) N(d)."""
    of = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return of(bigrams) - of(bigrams.sum(axis=0)) - of(bigrams.sum(axis=1))


def moved(data: bytes, cells: bytes, left: np.ndarray, right: np.ndarray) -> bytes:
    """The words of a bucket with the class under which their neighbours are likeliest. left, right: log P(neighbour's
    class | class)."""
    low, high, classes = unsqueeze(data)
    classes = classes.astype(np.int64)
    j, cell, n = _cells(cells)
    table = np.concatenate([left, right])  # SIDES x CLASSES
    for a in range(0, len(classes), CHUNK):
        x, y = np.searchsorted(j, [a, a + CHUNK])
        if x == y:
            continue
        head = np.flatnonzero(np.append(True, j[x + 1 : y] != j[x : y - 1]))
        fit = np.add.reduceat(table[cell[x:y]] * n[x:y, None], head, axis=0)
        classes[j[x:y][head]] = fit.argmax(axis=1)
    return squeeze(low, high, classes)


def exchange(coded: DataFrame, vocab: DataFrame, buckets: int, rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """The vocabulary's WORDS rows with the classes of the highest likelihood, and the likelihoods of all rounds."""
    n = max(parallelism(coded.sparkSession), buckets)
    known = vocab.filter(F.col("kind") == WORDS).withColumn("words", F.lit(None).cast("binary"))
    best, seen = known, []
    for step in range(rounds):
        pairs = coded.filter(F.col("kind") == NEIGHBOURS)
        met = _together(_placed(vocab, known, buckets).unionByName(pairs), n, "block", "kind").mapInArrow(_contexts, CODED)
        gathered = met.unionByName(known).withColumn("__o", -F.col("kind")).repartition(buckets, "bucket").sortWithinPartitions("bucket", "__o").drop("__o")
        summed = written(gathered.mapInArrow(_summed, CODED), "contexts")
        bigrams = class_bigrams(summed)
        seen.append(likelihood(bigrams))
        if len(seen) > 1 and seen[-1] <= max(seen[:-1]):
            break
        best = known
        if step + 1 == rounds or len(seen) > 1 and seen[-1] - seen[-2] < LEAST_RISE * abs(seen[-2]):
            break
        counts = bigrams + 0.1
        left = np.log(counts / counts.sum(axis=0, keepdims=True))[:, :CLASSES]
        right = np.log(counts / counts.sum(axis=1, keepdims=True)).T[:, :CLASSES]
        shared = coded.sparkSession.sparkContext.broadcast((left, right))  # SIDES x CLASSES numbers

        def move(batches, shared=shared):
            for _, kind, bucket, _, data, cells in _by_row(batches):
                yield _rows([(0, kind, bucket, [], moved(data, cells, *shared.value), None)])

        known = written(summed.mapInArrow(move, CODED), "classes")
    return best, seen


def class_lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    Learns from the rows for which ``train`` holds (null: not). Tokens are the words between ASCII white space with A-Z
    in lower case, then one end of text. base_score: log10 probability under add-one unigrams; score: under the class
    model. Null and empty texts are one end. Without training rows every word is unseen. Null ids stay; repeated rows
    are scored, and learnt from, as often as they occur. Other columns are not returned.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_docs, size = rows.agg(F.count_if("train"), F.sum(F.octet_length("text").cast("long"))).first()
    buckets = tasks_for(docs.sparkSession, size)
    coded = coded_corpus(rows, buckets)
    vocab = vocabulary(coded, buckets)
    known, _ = exchange(coded, vocab, buckets)
    return scores(coded, vocab, known, buckets, int(n_docs), id_col)


def word_classes(vocab: DataFrame, known: DataFrame) -> DataFrame:
    """word, n (its count in training documents) and class of all words that training documents hold."""

    def unpack(batches):
        names = None
        for _, kind, _, _, data, packed in _by_row(batches):
            if packed is not None:
                names = unpack_words(packed)
            else:
                n, classes = _counts_classes(data)
                use = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([names[i].decode() for i in use]), pa.array(n[use]), pa.array(classes[use], pa.int32())], names=["word", "n", "class"])

    both = vocab.filter(F.col("kind") == WORDS).unionByName(known.withColumn("words", F.lit(None).cast("binary")))
    return both.withColumn("__o", F.col("words").isNull()).repartition(parallelism(vocab.sparkSession), "bucket").sortWithinPartitions("bucket", "__o").drop("__o").mapInArrow(unpack, "word string, n long, class int")


def scores(coded: DataFrame, vocab: DataFrame, known: DataFrame, buckets: int, n_docs: int, id_col: str) -> DataFrame:
    spark = coded.sparkSession

    def totals(batches):
        total = np.zeros((CLASSES, 2), np.int64)
        for _, _, _, _, data, _ in _by_row(batches):
            n, classes = _counts_classes(data)
            np.add.at(total[:, 0], classes, n)
            total[:, 1] += np.bincount(classes[n > 0], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["class", "n", "words"])

    in_class, vocabulary_size = np.zeros(CLASSES), int(n_docs > 0)
    for row in known.mapInArrow(totals, "class int, n long, words long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():  # CLASSES
        in_class[row["class"]] = row["n"]
        vocabulary_size += row["words"]
    tokens = int(in_class.sum()) + n_docs
    base_of = np.log10(tokens + vocabulary_size + 1)
    class_size = np.maximum(in_class, 1)

    def statistics(batches):
        block, held, table = None, [], None
        for number, kind, _, ids, data, _ in _by_row(batches):
            if number != block:
                block, held, table = number, [], None
            if kind == DICTIONARY:
                held.append([x.astype(np.int64) for x in unsqueeze(data)])
                continue
            if table is None:
                size = sum(len(h[0]) for h in held)
                state, count, emission = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
                for places, _, seen, classes, low, high in held:
                    n = low | high << 32
                    state[places] = np.where(seen == 0, UNSEEN, np.where(seen == 1, CLASSES + 2 + classes, classes))
                    count[places] = n
                    emission[places] = np.where(n > 0, np.log10(np.maximum(n, 1) / class_size[classes]), 0.0)
                table, held = (state, count, np.log10(count + 1) - base_of, emission), []
            state, count, base, emission = table
            marked, codes = (x.astype(np.int64) for x in unsqueeze(data))
            sizes, trained = marked >> 1, (marked & 1).astype(bool)
            n = len(sizes)
            own = np.repeat(np.arange(n), sizes)
            full = np.repeat(np.arange(n), sizes + 1)
            seq = np.full(len(codes) + n, BORDER)
            inner = np.ones(len(seq), bool)
            inner[np.cumsum(sizes + 1) - 1] = False
            seq[inner] = state[codes]
            before = np.append(BORDER, seq[:-1])  # a text starts after the border of the one before
            keys, counts = np.unique(full * STATES * STATES + before * STATES + seq, return_counts=True)
            cut = np.searchsorted(keys // (STATES * STATES), np.arange(n + 1))
            cells = keys % (STATES * STATES)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(trained), pa.array(sizes + 1), pa.array(np.bincount(own, count[codes] > 0, n).astype(np.int64) + (n_docs > 0)),
                    pa.array(np.bincount(own, base[codes], n) + np.log10(n_docs + 1) - base_of), pa.array(np.bincount(own, emission[codes], n)),
                    pa.array([squeeze(cells[a:b], counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                ],
                names=["id", "train", "n_tokens", "n_known", "base", "emission", "pairs"],
            )

    met = _together(_placed(vocab, known, buckets).unionByName(coded.filter(F.col("kind") == DOCUMENTS)), max(parallelism(spark), buckets), "block", "kind")
    stats = written(met.mapInArrow(statistics, "id long, train boolean, n_tokens long, n_known long, base double, emission double, pairs binary"), "transitions")

    def transitions(batches):
        total = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for data in batch["pairs"].to_pylist():
                cells, counts = unsqueeze(data)
                total[cells] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["cell", "n"])

    seen = np.zeros(STATES * STATES)
    for cell, count in stats.filter("train").select("pairs").mapInArrow(transitions, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # STATES^2
        seen[cell] = count
    log_p = spark.sparkContext.broadcast(transition_logs(seen.reshape(STATES, STATES), in_class, n_docs))

    def score(batches):
        for batch in batches:
            found = []
            for data in batch["pairs"].to_pylist():
                cells, counts = unsqueeze(data)
                found.append(float(log_p.value[cells] @ counts))
            score = np.array(found) + np.asarray(batch["emission"])
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(~np.asarray(batch["train"], dtype=bool)), batch["n_tokens"], batch["n_known"], pa.array(np.full(len(found), tokens)), batch["base"], pa.array(score)],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return stats.mapInArrow(score, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def transition_logs(seen: np.ndarray, in_class: np.ndarray, n_docs: int) -> np.ndarray:
    """log10 P(state | previous state), flat, from counts of state pairs in training texts."""
    g = np.arange(CLASSES)
    once = CLASSES + 2 + g
    rows = np.zeros((CLASSES + 2, STATES))  # previous: a class, the border, an unseen word (as those seen once)
    rows[:CLASSES] = seen[g] + seen[once]
    rows[BORDER] = seen[BORDER]
    rows[UNSEEN] = seen[once].sum(axis=0)
    n = rows.sum(axis=1)
    rare = rows[:, once].sum(axis=1)
    everything = in_class.sum() + n_docs
    share = (seen[:, once].sum() + 1) / (everything + 2)
    unseen = (rare + KAPPA * share) / (n + KAPPA)
    prior = np.append(in_class, n_docs) / everything if everything else np.append(np.zeros(CLASSES), 1.0)
    counts = np.concatenate([rows[:, :CLASSES] + rows[:, once], rows[:, [BORDER]]], axis=1)
    p = (counts + MU * prior[None, :]) / (n + MU)[:, None] * (1 - unseen)[:, None]
    with np.errstate(divide="ignore"):
        p = np.log10(p)  # a class without words is never asked for
    out = np.zeros((STATES, STATES))
    previous = np.concatenate([g, [BORDER, UNSEEN], g])
    out[:, :CLASSES] = p[previous][:, :CLASSES]
    out[:, BORDER] = p[previous, CLASSES]
    out[:, UNSEEN] = np.log10(unseen)[previous]
    out[:, CLASSES + 2 :] = p[previous][:, :CLASSES]
    return np.where(np.isfinite(out), out, 0.0).ravel()
