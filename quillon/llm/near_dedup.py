"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, bands, weighted Jaccard.

1. Shingles are runs of five words. Their document frequencies over all documents are kept in 2^18 hashed counters, so
   the table has one size whatever the input. What other shingles add to a counter is taken off again (the median of
   all counters): what is left of it grows with the square root of the documents alone, so the weights tell frequent
   from rare shingles at every size. A shingle weighs (1 + TF x ln tf) x (1 + IDF x ln(N / df) / ln N).
2. Each of BANDS x ROWS samples picks one shingle with a probability in proportion to its weight, consistently over
   documents (Ioffe 2010; the sample's second part is left out, Li 2015). The random variables come from a pool that
   hashed shingles index.
3. Equal texts are one candidate, named by their digest. Candidates that share a band are compared: all pairs in
   buckets of at most SMALL. In larger ones all members are compared with one leader (the member whose bands have the
   most company, as the origin of a group of copies has), and, while that links many, what is not yet of the bucket's
   main class with other members of it.
4. What large buckets still hold of several classes is settled exactly, in blocks. Two texts of the wanted similarity
   share one of the rarest shingles of both (their prefixes: a fifth of the weight at 0.8), so texts whose prefix no
   text of another class shares are done. The others outside their bucket's main class are compared with all members
   of other classes, inside tasks that hold some MB of either side; each pair in the first band that it shares.
   Nothing is capped and no pairs are written out. A pair counts if the exact weighted Jaccard similarity of its
   shingles reaches the threshold.
5. Classes are the connected components, found by alternating stars. Links and components stay distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillon.llm.common import mix64, salted_join, slices, word_hashes, words, written

SHINGLE = 5
BANDS, ROWS = 12, 3
#: Hashed counters of document frequencies: 2 to the power of this.
DF_BITS = 18
#: How much a unique shingle weighs more than one that all documents have.
IDF = 0.2
#: How much a shingle weighs more that a text repeats e times.
TF = 0.2
POOL_BITS, LEVEL = 16, 0.03125
SMALL = 32
#: Leaders go on while they link at least this share of what is compared with them.
WORTH = 0.1
#: Bytes of text of either side that a block of a large bucket holds.
BLOCK_BYTES = 4 << 20
_PRIMES = [np.uint64(x) for x in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
HASH_BITS = 52


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of each distinct shingle of each text, in order of row and hash. A text of fewer than five
    words is one shingle, one without words has none. At most 4,096 texts."""
    dictionary, codes, at = words(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed = mix64(word_hashes(dictionary), 9)[codes]
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    rows = np.repeat(np.arange(len(n)), count)
    start = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    end = at[1:][rows]
    total = np.zeros(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            place = start + j
            total += np.where(place < end, hashed[np.minimum(place, len(hashed) - 1)], np.uint64(0)) * _PRIMES[j]
    key = np.sort(rows.astype(np.uint64) << np.uint64(HASH_BITS) | mix64(total, 5) >> np.uint64(64 - HASH_BITS))
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return (key[head] >> np.uint64(HASH_BITS)).astype(np.int64), key[head] & np.uint64((1 << HASH_BITS) - 1), np.diff(np.append(head, len(key)))


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(HASH_BITS - DF_BITS)).astype(np.int64)


def parts(batches, column: str):
    """Slices of at most 4,096 rows."""
    for batch in slices(batches, column):
        for at in range(0, batch.num_rows, 4096):
            yield batch.slice(at, 4096)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold a shingle of each counter, and all documents: sums made in each partition first."""

    def count(batches):
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in parts(batches, "text"):
            rows, hashes, _ = shingles(batch["text"])
            pairs = rows << DF_BITS | counter_of(hashes)  # in order: a counter is the hash's upper bits
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
            total += np.bincount(pairs & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
            n += batch.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()), pa.array(np.append(total[used], n), pa.int64())], names=["counter", "n"])

    sums = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    place, n = np.asarray(sums["counter"], dtype=np.int64), np.asarray(sums["n"], dtype=np.int64)
    out = np.zeros(1 << DF_BITS, np.int64)
    out[place[place >= 0]] = n[place >= 0]
    return out, int(n[place < 0].sum())


def idf_weights(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """The weight of a counter's shingles, without what a counter has of other shingles."""
    own = np.clip(frequencies - np.median(frequencies), 1, max(documents, 1))
    return (1 + IDF * np.log((documents + 1) / own) / np.log(documents + 2)).astype(np.float32)


def weights_of(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + TF * np.log(counts)) * idf[counter_of(hashes)]


def sampling_table(seed: int = 9) -> np.ndarray:
    """For each level of weight and member of the pool the sample's value ln a, as a number that sorts alike."""
    rng = np.random.default_rng(seed)
    size = 1 << POOL_BITS
    r, c, beta = rng.gamma(2, 1, size), rng.gamma(2, 1, size), rng.random(size)
    levels = np.arange(64)[:, None] * LEVEL
    t = np.floor(levels / r + beta)
    value = np.log(c) - r * (t - beta) - r
    return (np.clip((value + 64) * (1 << 25), 0, (1 << 32) - 1)).astype(np.uint64).astype(np.uint32)


def band_hashes(texts: pa.Array, idf: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text, and its BANDS hashes (rows of texts without shingles mean nothing)."""
    rows, hashes, counts = shingles(texts)
    sizes = np.bincount(rows, minlength=len(texts))
    signature = np.zeros((len(texts), BANDS * ROWS), np.uint64)
    if len(rows):
        level = np.clip(np.rint(np.log(weights_of(hashes, counts, idf)) / LEVEL), 0, 63).astype(np.int64) << POOL_BITS
        flat, low = pool.ravel(), hashes & np.uint64(0xFFFFFFFF)
        has = np.flatnonzero(sizes)
        at = np.cumsum(sizes[has]) - sizes[has]
        mixed = mix64(hashes, 77)
        for k in range(BANDS * ROWS):
            with np.errstate(over="ignore"):
                place = (mixed * (mix64(np.array([k]), 78)[0] | np.uint64(1)) >> np.uint64(64 - POOL_BITS)).astype(np.int64)
            place += level
            signature[has, k] = np.minimum.reduceat(flat[place].astype(np.uint64) << np.uint64(32) | low, at) & np.uint64(0xFFFFFFFF)
    bands = np.zeros((len(texts), BANDS), np.uint64)
    for b in range(BANDS):
        for k in range(ROWS):
            bands[:, b] = mix64(bands[:, b] ^ signature[:, b * ROWS + k], b * ROWS + k)
    return sizes, bands


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Similarity of left[i] and right[i]: the shingles' smaller weights over the larger ones."""
    n = len(left)
    sides = [shingles(x) for x in (left, right)]
    w = np.concatenate([weights_of(h, c, idf) for _, h, c in sides])
    rows = np.concatenate([s[0] for s in sides])
    key = rows.astype(np.uint64) << np.uint64(HASH_BITS) | np.concatenate([s[1] for s in sides])
    order = np.argsort(key, kind="stable")
    key, w, rows = key[order], w[order], rows[order]
    same = np.flatnonzero(key[1:] == key[:-1])  # a shingle of both
    both = np.bincount(rows[same], np.minimum(w[same], w[same + 1]), n)
    either = np.bincount(rows, w, n) - both
    return np.where(either > 0, both / np.maximum(either, 1e-12), 0.0)


def prefixes(texts: pa.Array, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each text's prefix: its shingles from the heaviest counter (the rarest) on, as long as they and
    what follows weigh at least threshold x all. Two texts of at least this similarity have the first of their common
    shingles in both prefixes."""
    rows, hashes, counts = shingles(texts)
    weight = weights_of(hashes, counts, idf)
    order = np.lexsort((hashes, -idf[counter_of(hashes)], rows))
    rows, hashes, weight = rows[order], hashes[order], weight[order]
    total = np.bincount(rows, weight, len(texts))
    before = np.cumsum(weight) - weight
    start = np.searchsorted(rows, np.arange(len(texts)))
    rest = total[rows] - (before - before[np.minimum(start, len(before) - 1)][rows]) if len(rows) else weight
    keep = rest >= threshold * total[rows] * (1 - 1e-9)
    return rows[keep], hashes[keep]


def block_links(asked: pa.Table, held: pa.Table, idf: np.ndarray, threshold: float, band: int) -> list[tuple[bytes, bytes]]:
    """Links of the texts asked with those held (node, root, bands, text) of other classes, whose first common band is
    ``band``."""

    def weighted(table: pa.Table):
        texts = table["text"].combine_chunks()
        found, at = [], 0
        for part in range(0, len(texts), 4096):
            rows, hashes, counts = shingles(texts.slice(part, 4096))
            found.append((rows + part, hashes, weights_of(hashes, counts, idf)))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def numbers(table: pa.Table):
        root = np.array([hash(r) for r in table["root"].to_pylist()], np.int64)
        bands = np.asarray(table["bands"].combine_chunks().flatten(), dtype=np.int64).reshape(-1, BANDS)
        return root, bands

    rows, hashes, weight = weighted(held)
    own_rows, own_hashes, own_weight = weighted(asked)
    known, codes = np.unique(hashes, return_inverse=True)
    size, own_size = np.bincount(rows, weight, held.num_rows), np.bincount(own_rows, own_weight, asked.num_rows)
    (root, bands), (own_root, own_bands) = numbers(held), numbers(asked)
    at = np.searchsorted(own_rows, np.arange(asked.num_rows + 1))
    ends = np.searchsorted(rows, np.arange(held.num_rows + 1))
    names, own_names = held["node"].to_pylist(), asked["node"].to_pylist()
    mark = np.zeros(len(known) + 1)
    out = []
    for i in range(asked.num_rows):
        able = (root != own_root[i]) & (bands[:, band] == own_bands[i, band]) & (np.minimum(size, own_size[i]) >= threshold * np.maximum(size, own_size[i]))
        if band:
            able &= ~(bands[:, :band] == own_bands[i, :band]).any(axis=1)
        able = np.flatnonzero(able)
        if not len(able):
            continue
        a, b = at[i], at[i + 1]
        place = np.searchsorted(known, own_hashes[a:b])
        there = known[np.minimum(place, len(known) - 1)] == own_hashes[a:b]
        mark[place[there]] = own_weight[a:b][there]
        lengths = ends[able + 1] - ends[able]
        cells = np.repeat(ends[able] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(np.repeat(np.arange(len(able)), lengths), np.minimum(weight[cells], mark[codes[cells]]), len(able))
        mark[place[there]] = 0
        linked = able[both >= threshold * (size[able] + own_size[i] - both)]
        out += [(own_names[i], names[j]) for j in linked.tolist()]
    return out


def _similar(pairs: DataFrame, texts: DataFrame, idf, threshold: float, hot: bool) -> DataFrame:
    """The pairs (a, b) that are similar. With ``hot`` b may be one text of very many pairs."""

    def compare(batches):
        for batch in parts(batches, "ta"):
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                linked = pa.array(weighted_jaccard(some["ta"], some["tb"], idf.value) >= threshold)
                yield pa.RecordBatch.from_arrays([some["a"].filter(linked), some["b"].filter(linked)], names=["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    met = salted_join(one, two.join(pairs.select("b").distinct(), "b", "left_semi"), ["b"], "a") if hot else one.join(two, "b")
    return met.select("a", "b", "ta", "tb").mapInArrow(compare, "a binary, b binary")


def _counted(df: DataFrame, name: str, *columns: str) -> tuple[DataFrame, tuple]:
    """df as a table in the shared folder, with its row count and checksum, taken while it is written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")), name)
    return table, (seen.get["n"], seen.get["sum"])


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for the nodes of edges (a, b), by alternating large and small
    stars; each round is written to the shared folder."""
    now, state = _counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", "u", "v")
    before = None
    while state[0] and state != before:
        before = state
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        now, state = _counted(small, "edges", "u", "v")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").drop("__node").withColumn("root", F.coalesce("root", "node"))


def _unresolved(large: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of large buckets of several classes, with their ``root`` and their bucket's ``main`` class."""
    placed = _with_roots(large, roots)
    mains = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("classes"))
    return salted_join(placed, mains.filter("classes > 1").select("key", "main"), ["key"], "node")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    return components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def _classes(members: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """node and root for the texts of members (node, bands, weight, band, key, n: the bucket's size) that have a link."""
    small, large = members.filter(F.col("n") <= SMALL), members.filter(F.col("n") > SMALL)
    other = small.select("key", F.col("node").alias("b"))
    near = small.select("key", F.col("node").alias("a")).join(other, "key").filter("a < b").select("a", "b").distinct()
    leaders = large.groupBy("key").agg(F.max_by("node", F.struct("weight", F.xxhash64("key", "node"))).alias("b"))
    led = salted_join(large.select("key", F.col("node").alias("a")), leaders, ["key"], "a").filter("a <> b").select("a", "b").distinct()
    links, _ = _counted(_similar(near, texts, idf, threshold, False).unionByName(_similar(led, texts, idf, threshold, True)), "links", "a", "b")
    roots = components(links)
    step = 0
    while True:  # other leaders, for what is not of a bucket's main class
        step += 1
        left, (n, _) = _counted(_unresolved(large, roots).select("node", "root", "bands", "band", "key", "main"), "left", "node")
        if not n:
            return roots
        leaders = left.filter("root = main").groupBy("key").agg(F.max_by("node", F.xxhash64(F.lit(step), "key", "node")).alias("b"))
        asked, (compared, _) = _counted(salted_join(left.filter("root <> main").select("key", F.col("node").alias("a")), leaders, ["key"], "a").select("a", "b").distinct(), "asked", "a", "b")
        links, (found, _) = _counted(_similar(asked, texts, idf, threshold, True), "links", "a", "b")
        if found:
            roots = _joined(roots, links)
        if found < WORTH * compared:
            break
    if found:
        left, _ = _counted(_unresolved(large, roots).select("node", "root", "bands", "band", "key", "main"), "left", "node")
    links, (found, _) = _counted(_block_pass(left, texts, idf, threshold), "links", "a", "b")
    return _joined(roots, links) if found else roots


def _block_pass(left: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """All links (a, b) between texts of different classes that share a large bucket."""

    def rare(batches):
        for batch in parts(batches, "text"):
            rows, hashes = prefixes(batch["text"], idf.value, threshold)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch["node"].take(at), batch["root"].take(at)], names=["s", "node", "root"])

    prefix = left.select("node", "root").distinct().join(texts, "node").select("node", "root", "text").mapInArrow(rare, "s long, node binary, root binary")
    prefix = written(prefix, "prefixes")
    mixed = prefix.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("s")
    active = salted_join(prefix.select("s", "node"), mixed, ["s"], "node").select("node").distinct()
    rows = left.join(active, "node", "left_semi").join(texts, "node").withColumn("bytes", F.octet_length("text").cast("long"))
    rows = written(rows.select("key", "band", "node", "root", "bands", "bytes", "text", (F.col("root") != F.col("main")).alias("asks")), "unresolved")
    blocks = lambda c: F.ceil(F.sum(c) / BLOCK_BYTES).cast("int")
    grid = rows.groupBy("key").agg(blocks("bytes").alias("wide"), blocks(F.when(F.col("asks"), F.col("bytes"))).alias("tall")).filter("tall > 0")
    placed = salted_join(rows, grid, ["key"], "node")
    part = lambda c: F.pmod(F.xxhash64(F.lit(4), "node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    columns = ["key", "band", "node", "root", "bands", "text"]
    held = placed.select(*columns, F.lit(False).alias("asks"), every("tall").alias("p"), part("wide").alias("q"))
    asks = placed.filter("asks").select(*columns, "asks", part("tall").alias("p"), every("wide").alias("q"))

    def compare(block: pa.Table) -> pa.Table:
        mask = block["asks"].combine_chunks()
        found = block_links(block.filter(mask), block.filter(pc.invert(mask)), idf.value, threshold, block["band"][0].as_py())
        columns = list(zip(*found, strict=True)) or [(), ()]
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["a", "b"])

    return held.unionByName(asks).groupBy("key", "p", "q").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and class_id (the smallest id of the class), one row per id.

    Texts are one class if they are equal or linked by pairs whose weighted Jaccard similarity is at least threshold.
    Null texts are empty; texts without words equal only those with the same characters. Ids are integers; rows with
    a null id take no part. An id that several rows repeat, with one text or with several, is in the class of each of
    its texts, and gets the smallest class_id of them. Other columns don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    frequencies, documents = document_frequencies(rows)
    idf = spark.sparkContext.broadcast(idf_weights(frequencies, documents))  # 2^DF_BITS numbers
    names = [f"b{k}" for k in range(BANDS)]

    def sign(batches):
        pool = sampling_table()
        for batch in parts(batches, "text"):
            sizes, bands = band_hashes(batch["text"], idf.value, pool)
            columns = [pa.array(bands[:, k].view(np.int64), mask=sizes == 0) for k in range(BANDS)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["node"], *columns], names=["id", "node", *names])

    signed = written(rows.select("id", "node", "text").mapInArrow(sign, "id long, node binary, " + ", ".join(f"{c} long" for c in names)), "signed")
    one = written(signed.groupBy("node").agg(F.min("id").alias("id"), *[F.min(c).alias(c) for c in names]).select("node", "id", F.array(*names).alias("bands")), "texts")  # equal texts have equal bands
    inside = one.filter(F.col("bands")[0].isNotNull()).select("node", "bands", F.posexplode("bands").alias("band", "h")).withColumn("key", F.xxhash64("band", "h"))
    shared = inside.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    company = F.sum("n").over(Window.partitionBy("node"))  # BANDS rows at most
    members = written(salted_join(inside.drop("h"), shared, ["key"], "node").withColumn("weight", company), "members")
    wanted = one.join(members.select("node").distinct(), "node", "left_semi").select("node", "id")
    texts = written(rows.join(wanted, ["node", "id"]).select("node", "text").dropDuplicates(["node"]), "texts")
    roots = _classes(members, texts, idf, threshold)
    found = _with_roots(one.select("node", "id"), roots)
    smallest = found.groupBy("root").agg(F.min("id").alias("class_id"))
    named = salted_join(roots, smallest, ["root"], "node").select("node", "class_id")
    return signed.join(named.unionByName(one.join(roots.select("node"), "node", "left_anti").select("node", F.col("id").alias("class_id"))), "node").groupBy(F.col("id").alias(id_col)).agg(F.min("class_id").alias("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents whose class has a smaller id; rows with a null id stay. Rows as in
    :func:`near_duplicate_classes`; an empty table gives no rows."""
    gone = near_duplicate_classes(docs, threshold, id_col, text_col).filter(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
