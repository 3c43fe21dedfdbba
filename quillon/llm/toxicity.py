"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms: words without punctuation at their ends, and the first four and five
letters of longer words. The score is the logistic of a bias, a weight for each term and, for each pair of terms, the
product of two short vectors: pairs weigh more (or less) than their terms do alone.

The model is fitted on a bounded sample of labelled rows (``MAX_ROWS``, chosen by a hash of the id over the whole
label table): terms that go with a label more than chance would have it get weights with an L1 penalty, which leaves
few; then vectors of all terms of at least ``LEAST_ROWS`` rows are fitted, and those weights with them, in tasks. A part
of the sample only judges how far the vectors help. Scoring reads every whole text and needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import give_back, mix64, slices, word_hashes, words, written

#: Labelled rows that a model is fitted on at most.
MAX_ROWS = 16_000
#: Hashed terms: 2 to the power of this.
BITS = 18
#: Length of a term's vector.
FACTORS = 8
#: A term has a vector if so many rows of the sample have it, and may have a weight if its chi-square with the label is at
#: least this.
LEAST_ROWS, LEAST_CHI2 = 3, 16.0
#: Vectors: how often the sample is gone through at most, and L2 penalty.
ROUNDS, SHRINK = 8, 0.3
#: One row in so many teaches nothing and judges the vectors; rounds without a better one after which none follows; shares
#: of the pairs that are tried.
JUDGES, PATIENCE, SHARES = 8, 2, (0.1, 0.25, 0.5, 0.75, 1.0)
#: Rows of either label that must be among the judges.
LEAST_JUDGES = 8
#: Steps, and sums of squared gradients that the vectors' steps start from: careful ones, which long texts need, then bold
#: ones, which pairs of neutral terms need. Both are tried.
STARTS = ((0.02, 30.0), (0.1, 1.0))
#: Rows that one task learns from; parts' results are averaged.
PART_ROWS = 4_096
#: Code points trimmed from the ends of words.
MARKS = ".,;:!?\"'()[]{}<>|%$&*#@~^_=+/\\-"


def term_ids(dictionary: pa.Array, bits: int = BITS) -> np.ndarray:
    """Three hashed terms of each word: itself, its first four and its first five letters (-1: none)."""
    bare = pc.ascii_trim(pc.utf8_lower(dictionary), characters=MARKS)
    length = np.asarray(pc.utf8_length(bare), dtype=np.int64)
    out = np.full((3, len(length)), -1, np.int64)
    for k, (least, part) in enumerate(((1, bare), (6, pc.utf8_slice_codeunits(bare, 0, 4)), (6, pc.utf8_slice_codeunits(bare, 0, 5)))):
        out[k] = np.where(length >= least, (mix64(word_hashes(part), 70 + k) >> np.uint64(64 - bits)).astype(np.int64), -1)
    return out


def term_sets(texts: pa.Array, bits: int = BITS, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of each distinct term of each text, in order; with ``active`` (a mask) of those terms alone."""
    dictionary, codes, at = words(texts)
    ids = term_ids(dictionary, bits)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = []
    for one in ids:
        wanted = (one >= 0) & (active[one] if active is not None else True)
        use = wanted[codes]
        found.append(rows[use] << bits | one[codes[use]])
    pairs = np.unique(np.concatenate(found))
    return pairs >> bits, pairs & ((1 << bits) - 1)


@dataclass
class ToxicityModel:
    bias: float
    weights: np.ndarray  # of all hashed terms, most of them 0
    vectors: np.ndarray  # of all hashed terms

    def score(self, texts: pa.Array) -> np.ndarray:
        rows, terms = term_sets(texts, int(np.log2(len(self.weights))), (self.weights != 0) | self.vectors.any(axis=1))
        return _logistic(_raw(self.bias, self.weights, self.vectors, rows, terms, len(texts)))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _raw(bias, weights, vectors, rows, terms, n) -> np.ndarray:
    out = bias + np.bincount(rows, weights[terms], n)
    for f in range(vectors.shape[1]):
        v = vectors[terms, f]
        out += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
    return out


@dataclass
class _State:
    """What the rounds over pairs work on: the model, and the sums of squared gradients that its steps go by."""

    rate: float
    bias: float
    w: np.ndarray
    v: np.ndarray
    hb: float
    hw: np.ndarray
    hv: np.ndarray


def fit_arrays(rows: np.ndarray, terms: np.ndarray, labels: np.ndarray, bits: int = BITS) -> ToxicityModel:
    """Fits on rows given as (row, term) pairs in order of row, and labels of 0 and 1: all in this process, in one part."""
    at = np.searchsorted(rows, np.arange(len(labels) + 1))
    size = 1 << bits
    judges = np.arange(len(labels)) % JUDGES == JUDGES - 1
    lists = [terms[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    taught, judging = [x for x, j in zip(lists, judges, strict=True) if not j], [x for x, j in zip(lists, judges, strict=True) if j]
    y = labels[~judges]
    flat = np.concatenate([*taught, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(y)), [len(x) for x in taught])
    counts = np.bincount(flat, minlength=size), np.bincount(flat[y[of] > 0], minlength=size)
    related, common = _kinds(*counts, y)
    own = [x[related[x]] for x in taught]
    model = _linear(own, y, size)
    return _with_pairs(model, common, judging, labels[judges], lambda state, step: _epoch(state, taught, y, common, step))


def _kinds(with_term: np.ndarray, in_positive: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms that may have weights, terms that have vectors). Chi-square is of a term's presence against the label: the
    weight of a rare or neutral term can only be learnt by heart, but a term that is neutral alone may matter in a pair,
    so all that are not rare get vectors."""
    n, positive = max(len(labels), 1), float(labels.sum())
    expected = with_term * positive / n
    spread = expected * (1 - positive / n) * (1 - with_term / n)
    common = with_term >= LEAST_ROWS
    return common & ((in_positive - expected) ** 2 >= LEAST_CHI2 * np.maximum(spread, 1e-9)), common


def _linear(own: list[np.ndarray], labels: np.ndarray, size: int, factors: int = FACTORS, seed: int = 7, l1: float = 0.5, l2: float = 0.02) -> ToxicityModel:
    """Bias and weights of rows given as lists of the terms that may have weights; no vectors yet."""
    n = len(labels)
    weights, vectors = np.zeros(size), np.zeros((size, factors), np.float32)
    positive = float(labels.sum())
    if not n or positive in (0, n):
        # nothing to tell apart: the share of label 1, and 0 without labels
        return ToxicityModel(35.0 if n and positive else -35.0, weights, vectors)
    rng = np.random.default_rng(seed)
    # follow the regularised leader, each coordinate with its own step and an L1 threshold
    z, g2 = np.zeros(size), np.zeros(size)
    bias = float(np.log(positive / (n - positive)))
    gb = 0.0
    for _ in range(8):
        for block in np.array_split(rng.permutation(n), -(-n // 64)):
            idx = np.concatenate([own[i] for i in block])
            row = np.repeat(np.arange(len(block)), [len(own[i]) for i in block])
            used, inverse = np.unique(idx, return_inverse=True)
            w = np.where(np.abs(z[used]) <= l1, 0.0, -(z[used] - np.sign(z[used]) * l1) / (4.0 * (1.0 + np.sqrt(g2[used])) + l2))
            error = _logistic(bias + np.bincount(row, w[inverse], len(block))) - labels[block]
            g = np.bincount(inverse, error[row], len(used))
            sigma = 4.0 * (np.sqrt(g2[used] + g * g) - np.sqrt(g2[used]))
            z[used] += g - sigma * w
            g2[used] += g * g
            gb += float(error.sum()) ** 2
            bias -= 0.5 * float(error.sum()) / (1 + np.sqrt(gb))
    weights = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / (4.0 * (1.0 + np.sqrt(g2)) + l2))
    model = ToxicityModel(bias, weights, vectors)
    _fit_weights(model, np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own).astype(np.int64), labels, l2)
    return model


def _fit_weights(model: ToxicityModel, rows, terms, labels, l2: float) -> None:
    """Bias and the weights that are not 0, with the L2 penalty alone."""
    n = len(labels)
    active = np.flatnonzero(model.weights)
    place = np.full(len(model.weights), -1)
    place[active] = np.arange(len(active))
    use = place[terms] >= 0
    rows, terms = rows[use], place[terms[use]]
    w, bias = model.weights[active], model.bias
    hw, hb = np.full(len(active), 1e-6), 1e-6
    for _ in range(200):
        error = (_logistic(bias + np.bincount(rows, w[terms], n)) - labels) / n
        gw = np.bincount(terms, error[rows], len(active)) + l2 * w / n
        hw += gw * gw
        hb += float(error.sum()) ** 2
        w, bias = w - 0.1 * gw / np.sqrt(hw), bias - 0.1 * float(error.sum()) / np.sqrt(hb)
    model.weights[active], model.bias = w, float(bias)


def _epoch(state: _State, lists: list[np.ndarray], labels: np.ndarray, common: np.ndarray, seed: int) -> _State:
    """The state after one pass over the rows in blocks: vectors of the common terms, and bias and weights with them."""
    rng = np.random.default_rng(seed)
    s = _State(state.rate, state.bias, state.w.copy(), state.v.copy(), state.hb, state.hw.copy(), state.hv.copy())
    for block in np.array_split(rng.permutation(len(labels)), max(1, -(-len(labels) // 128))):
        some = [(i, x) for i in block.tolist() if len(x := lists[i][common[lists[i]]])]
        if not some:
            continue
        y = labels[[i for i, _ in some]]
        own, lengths = np.concatenate([x for _, x in some]).astype(np.int32), np.array([len(x) for _, x in some])
        order = np.argsort(own, kind="stable")
        starts = np.cumsum(lengths) - lengths
        ordered = own[order]
        head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        used = ordered[head]
        one = s.v[own]
        total = np.add.reduceat(one, starts)
        pairs = 0.5 * ((total * total).sum(1) - np.add.reduceat((one * one).sum(1), starts))
        error = (_logistic(s.bias + np.add.reduceat(s.w[own], starts) + pairs) - y).astype(np.float32)
        each = np.repeat(error, lengths)
        g = np.add.reduceat((each[:, None] * (np.repeat(total, lengths, axis=0) - one))[order], head) + SHRINK * s.v[used]
        s.hv[used] += g * g
        s.v[used] -= s.rate * g / np.sqrt(s.hv[used])
        gw = np.where(s.w[used] != 0, np.add.reduceat(each[order], head), 0)
        s.hw[used] += gw * gw
        s.w[used] -= s.rate * gw / np.sqrt(s.hw[used])
        s.hb += float(error.sum()) ** 2
        s.bias -= s.rate * float(error.sum()) / np.sqrt(s.hb)
    return s


def _losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _with_pairs(model: ToxicityModel, common: np.ndarray, judging: list[np.ndarray], y: np.ndarray, one_round) -> ToxicityModel:
    """The model with vectors, as far as rows that teach nothing say that they help: after each round those judge how
    much of the pairs to take (SHARES), and the best of all rounds stays. It must beat the model without vectors by the
    standard error of the difference, and few judges (LEAST_JUDGES) judge nothing."""
    if min(y.sum(), len(y) - y.sum()) < LEAST_JUDGES or abs(model.bias) == 35.0:
        return model
    size, factors = model.vectors.shape
    rows, terms = np.repeat(np.arange(len(y)), [len(x) for x in judging]), np.concatenate([*judging, np.zeros(0, np.int64)]).astype(np.int64)
    nothing = np.zeros((size, 0), np.float32)
    plain = _losses(_logistic(_raw(model.bias, model.weights, nothing, rows, terms, len(y))), y)
    best, least = model, np.inf
    for rate, start in STARTS:
        v = np.where(common[:, None], np.random.default_rng(11).normal(0, 0.01, (size, factors)), 0).astype(np.float32)
        state, since = _State(rate, model.bias, model.weights.copy(), v, 1.0, np.full(size, 1.0), np.full((size, factors), start, np.float32)), 0
        for step in range(ROUNDS):
            state = one_round(state, step)
            alone = _raw(state.bias, state.w, nothing, rows, terms, len(y))
            pairs = _raw(0.0, np.zeros(size), state.v, rows, terms, len(y))
            since += 1
            for share in SHARES:
                losses = _losses(_logistic(alone + share * pairs), y)
                gain = plain - losses
                if losses.mean() < least and gain.mean() > gain.std() / np.sqrt(len(y)):
                    best, least, since = ToxicityModel(state.bias, state.w, state.v * np.float32(np.sqrt(share))), losses.mean(), 0
            if since >= PATIENCE:
                break
    return best


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7) -> ToxicityModel:
    """A model of ``labels`` (id and a label of 0 or 1) for the texts of ``docs``.

    Of the labelled rows the ``max_rows`` with the smallest hash of the id are used; rows that repeat an id, with one
    label or several, are rows of their own. Null ids and labels take no part; null texts are empty. Without labelled
    rows, or with one class alone, scores are 0 (or 1, if all are 1).

    The rows' terms stay in the shared folder. Tasks count terms and go through parts of PART_ROWS rows; the driver gets
    the counts, the terms that may have weights, the rows that judge (one in JUDGES) and the parts' states: numbers that
    ``max_rows`` and the number of hashed terms bound.
    """
    spark, size = docs.sparkSession, 1 << BITS
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .orderBy(F.xxhash64(F.lit(seed), "__id"), "__id", "__y")
        .limit(max_rows)
    )

    def features(batches):
        for batch in slices(batches, "text"):
            rows, terms = term_sets(batch["text"])
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch["__o"], batch["__y"], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(terms, pa.int32()))], names=["__o", "__y", "terms"]
            )

    every = written(
        docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "__id")  # max_rows rows of two numbers
        .select(F.xxhash64(F.lit(seed), "__id", "text").alias("__o"), "__y", "text")
        .mapInArrow(features, "__o long, __y int, terms array<int>"),
        "terms",
    )
    last = every.select("__o").orderBy("__o").limit(max_rows).agg(F.max("__o"), F.count(F.lit(1))).first()  # repeated ids may be more rows
    if not last[1]:
        return _linear([], np.zeros(0), size)
    sample = every.filter(F.col("__o") <= last[0])
    judges = F.pmod(F.xxhash64(F.lit(seed + 1), "__o"), F.lit(JUDGES)) == JUDGES - 1
    taught = sample.filter(~judges)
    found = taught.select("__y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("p")).toArrow()  # a row for each hashed term
    counts = np.zeros((2, size))
    counts[0, np.asarray(found["term"])], counts[1, np.asarray(found["term"])] = np.asarray(found["n"]), np.asarray(found["p"])
    y = np.asarray(taught.select("__y").toArrow()["__y"], dtype=np.float64)
    related, common = _kinds(counts[0], counts[1], y)

    def own_terms(batches):
        for batch in batches:
            flat = np.asarray(batch["terms"].flatten())
            ends = np.concatenate([[0], np.cumsum(related[flat])])[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch["terms"])))])]
            yield pa.RecordBatch.from_arrays([batch["__o"], batch["__y"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[related[flat]], pa.int32()))], names=["__o", "__y", "terms"])

    own, y = _lists(taught.mapInArrow(own_terms, taught.schema).orderBy("__o", "__y"))
    model = _linear(own, y, size)
    judging, judged = _lists(sample.filter(judges).orderBy("__o", "__y"))
    parts = max(1, -(-len(y) // PART_ROWS))
    dealt = taught.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 2), "__o"), F.lit(parts)).cast("int"))

    columns = ["w", "hw", *(f"v{i}" for i in range(FACTORS)), *(f"h{i}" for i in range(FACTORS))]
    kinds = "term int, " + ", ".join(f"{c} float" for c in columns)

    def one_round(state: _State, step: int) -> _State:
        """The mean of what the parts make of the state; of a term, over the parts that have moved it."""
        shared = spark.sparkContext.broadcast((state, common))  # the model's size, whatever the input

        def learn(key, table):
            before, of_use = shared.value
            lists, labels = _of(table.take(pc.sort_indices(table, sort_keys=[("__o", "ascending"), ("__y", "ascending")])))
            after = _epoch(before, lists, labels, of_use, step)
            at = np.flatnonzero((after.hv != before.hv).any(1))
            moved = np.column_stack([after.w[at], after.hw[at], after.v[at], after.hv[at]]).astype(np.float32)
            own = np.zeros((1, moved.shape[1]), np.float32)  # of term -1: bias
            own[0, :2] = after.bias, after.hb
            values = np.vstack([moved, own]).T
            return pa.table([pa.array(np.append(at, -1), pa.int32()), *map(pa.array, np.ascontiguousarray(values))], names=["term", *columns])

        met = dealt.groupBy("part").applyInArrow(learn, kinds).groupBy("term").agg(*[F.avg(c).cast("float").alias(c) for c in columns]).toArrow()  # a row for each hashed term
        shared.destroy()
        term = np.asarray(met["term"])
        at, own = term >= 0, np.flatnonzero(term < 0)[:1]
        out = _State(state.rate, float(np.asarray(met["w"])[own][0]), state.w.copy(), state.v.copy(), float(np.asarray(met["hw"])[own][0]), state.hw.copy(), state.hv.copy())
        out.w[term[at]], out.hw[term[at]] = np.asarray(met["w"])[at], np.asarray(met["hw"])[at]
        for i in range(FACTORS):
            out.v[term[at], i], out.hv[term[at], i] = np.asarray(met[f"v{i}"])[at], np.asarray(met[f"h{i}"])[at]
        del met
        give_back()
        return out

    out = _with_pairs(model, common, judging, judged, one_round)
    give_back()
    return out


def _of(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Lists of terms, and labels, of rows."""
    lists = table["terms"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), dtype=np.int64))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], np.asarray(table["__y"], dtype=np.float64)


def _lists(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    return _of(rows.select("terms", "__y").toArrow())


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic`` (1 if it is at least threshold, else 0), from the whole text
    alone. Null and empty texts have the score of a document without terms. Columns with these names are replaced."""
    keep = [f for f in docs.schema.fields if f.name not in ("toxicity", "toxic")]
    names = [f.name for f in keep]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS x (FACTORS + 1) numbers, whatever the input

    def add(batches):
        for batch in slices(batches, text_col):
            p = shared.value.score(batch[text_col])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "toxicity", "toxic"])

    return docs.mapInArrow(add, T.StructType([*keep, T.StructField("toxicity", T.DoubleType()), T.StructField("toxic", T.IntegerType())]))
