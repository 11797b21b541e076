"""Near-dedup: an LSH forest of sorted MinHash orders, links confirmed on full shingle sets.

1. Every document gives its set of distinct word shingles (64-bit hashes), a
   128-bit digest of the set and a MinHash signature. Equal sets are one class.
2. Forest: ``ORDERS`` orders, each over ``DEPTH`` positions of the signature, are
   range-partitioned and sorted together. Neighbours whose longest common prefix
   is deep enough are candidates. The depth adapts: a region that holds more than
   ``REGION`` classes is cut one or two positions deeper; ``DENSE_ORDERS`` further
   orders, always at the deepest cut, keep the recall there. Chains of neighbours
   need one edge per class and order, however large a region is.
3. The candidates' connected parts are the units of exact work. A unit is split
   into blocks of bounded size. Inside a block a search from class to class
   takes exact intersections of full sets with all classes not reached yet.
4. Units of one block are settled. In larger ones every block also holds a few
   common hubs, which tie the blocks together; what is then outside the largest
   group of its unit meets every block of the unit, tile by tile. So two classes
   of a unit are left uncompared only if they are already connected.

Only candidate edges, never pairs within a region, pass between tasks.

Defined cases: texts without words have empty sets, link with nothing and stay;
texts of fewer words than a shingle have one shingle, the whole sequence; a null
``doc_id`` is never the smallest id of its group unless there is no other; rows
that repeat an id are separate rows of the result and one row in ``keep_one``;
an empty table gives an empty result; further columns pass whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_of, documents, freeing, hash_words, mix, small_batches, space_words, translate, written
from .components import apart, connected, local_components
from .substring_dedup import _whole_parts as whole_parts
from .substring_dedup import rolling
from .token_files import ragged_take

SIGNATURE, ORDERS, DEPTH, REGION = 128, 32, 8, 64
#: Further orders at the depth of dense regions, where a prefix is shared less often.
DENSE_ORDERS = 40
#: Classes and shingles of a block of exact work, and hubs common to the blocks of a unit.
BLOCK_CLASSES, BLOCK_SHINGLES, HUBS = 1000, 2_000_000, 16

LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SEEDS = np.random.default_rng(11).integers(1, 1 << 32, (3, SIGNATURE), dtype=np.uint32) | np.uint32(1)
_POSITIONS = np.stack([np.random.default_rng(100 + o).permutation(SIGNATURE)[:DEPTH] for o in range(ORDERS + DENSE_ORDERS)])


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted inside a text, and the offsets of the texts."""
    distinct, codes, ends = space_words(translate(texts, LOWER))
    n = len(ends) - 1
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    hashes = mix(hash_words(distinct))[codes]
    size = np.diff(ends)
    docs, found = [], []
    if len(hashes) >= words:
        whole = rolling(hashes, (words,))[0]
        doc = doc_of(ends)
        inside = doc[: len(whole)] == doc[words - 1 :]
        docs.append(doc[: len(whole)][inside])
        found.append(whole[inside])
    for i in np.flatnonzero((size > 0) & (size < words)):
        docs.append(np.array([i]))
        found.append(mix(rolling(hashes[ends[i] : ends[i + 1]], (int(size[i]),))[0] + np.uint64(size[i])))
    doc, shingle = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    return shingle[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SIGNATURE) 16-bit marks of the MinHash values; texts without shingles are zero."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, SIGNATURE), np.uint16)
    if len(full):
        base = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
        for i in range(SIGNATURE):
            x = (base ^ _SEEDS[0, i]) * _SEEDS[1, i]
            x ^= x >> np.uint32(15)
            x *= _SEEDS[2, i]
            least = np.minimum.reduceat(x, offsets[:-1][full])
            out[full, i] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as binary values."""
    offsets = (np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (16 bytes), signature per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, offsets = shingle_sets(batch.column(2).cast(pa.string()), words)
            digests = [xxhash.xxh3_128_digest(shingles[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.binary()),
                 _binary(signatures(shingles, offsets).view(np.uint8))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(freeing(run), "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def depths(threshold: float) -> tuple[int, int]:
    """Prefix lengths of sparse and of dense regions: a linked pair shares the first in about two of five orders."""
    least = int(np.clip(round(np.log(0.38) / np.log(threshold)), 1, DEPTH - 2)) if threshold < 1 else DEPTH - 2
    return least, least + 2


def prefix_links(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """Whether each sorted row after the first links to the one before; ``keys``: (rows, 1 + DEPTH) order and marks."""
    same = keys[1:] == keys[:-1]
    shared = np.where(same[:, 0], np.cumprod(same[:, 1:], 1).sum(1), 0)
    depth = np.full(len(shared), most)
    for d in range(most - 1, least - 1, -1):
        run = np.concatenate([[0], np.cumsum(shared < d)])
        depth[(np.bincount(run)[run] <= REGION)[1:]] = d
    depth[keys[1:, 0] >= ORDERS] = most
    return shared >= depth


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) edges between classes (first 8 bytes of their digests): neighbours in some order of the forest."""
    least, most = depths(threshold)

    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, SIGNATURE)
            for o in range(ORDERS + DENSE_ORDERS):
                key = np.empty((n, 1 + 2 * DEPTH), np.uint8)
                key[:, 0] = o
                key[:, 1:] = np.ascontiguousarray(marks[:, _POSITIONS[o]].astype(">u2")).view(np.uint8)
                yield pa.RecordBatch.from_arrays([_binary(key), batch.column(0)], names=["key", "node"])

    def matrix(keys: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 1 + 2 * DEPTH)
        return np.concatenate([raw[:, :1].astype(np.uint16), np.ascontiguousarray(raw[:, 1:]).view(">u2").astype(np.uint16)], 1)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        keys = np.concatenate([matrix(b.column(0).to_pylist()) for b in parts])
        node = np.concatenate([np.asarray(b.column(1)) for b in parts])
        ends = [parts[0].column(0)[0].as_py(), parts[-1].column(0)[-1].as_py()]
        names = ["a", "b", "key"]
        yield pa.RecordBatch.from_arrays([pa.array(node[[0, -1]]), pa.nulls(2, pa.int64()), pa.array(ends, pa.binary())], names=names)
        at = np.flatnonzero(prefix_links(keys, least, most)) + 1
        a, b = local_components(node[at - 1], node[at])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], names=names)

    rows = classes.select(F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("node"), "signature")
    sorted_rows = rows.mapInArrow(orders, "key binary, node long").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = written(sorted_rows.mapInArrow(freeing(neighbours), "a long, b long, key binary"), "near-links")
    # First and last row of each range partition, two per task: neighbours across the cuts.
    cuts = found.filter("key is not null").select("key", F.col("a").alias("node")).orderBy("key", "node").toArrow()
    links = found.filter("key is null").select("a", "b")
    if cuts.num_rows > 1:
        near = np.flatnonzero(prefix_links(matrix(cuts["key"].to_pylist()), least, least)) + 1
        node = cuts["node"].to_numpy()
        if len(near):
            across = [(int(node[i]), int(node[i - 1])) for i in near if node[i] != node[i - 1]]
            links = links.unionByName(classes.sparkSession.createDataFrame(across, "a long, b long"))
    return links


def linked_groups(shingles: np.ndarray, offsets: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest number of each set's connected group, links being den * |x & y| >= num * |x | y|, exactly.

    A set that has been reached is not looked at again, so a group of copies
    costs one search per member over what is not reached yet.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    _, ids = np.unique(shingles, return_inverse=True)
    label, open_ = np.full(n, -1), np.ones(n, bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(n), size)
        use = open_[owner]
        order = np.argsort(ids[use], kind="stable")
        return owner[use][order], np.concatenate([[0], np.cumsum(np.bincount(ids[use], minlength=ids.max() + 1))])

    owners, starts = postings()
    at_build = n
    for first in range(n):
        if label[first] >= 0:
            continue
        label[first], open_[first] = first, False
        queue = [first]
        while queue and open_.any():
            x = queue.pop()
            if open_.sum() * 2 < at_build:
                owners, starts = postings()
                at_build = int(open_.sum())
            met, _ = ragged_take(owners, starts, ids[offsets[x] : offsets[x + 1]])
            both = np.bincount(met, minlength=n)
            near = open_ & (both > 0) & (den * both >= num * (size[x] + size - both))
            reached = np.flatnonzero(near)
            label[reached], open_[reached] = first, False
            queue.extend(reached.tolist())
    return label


def _exact(words: int, num: int, den: int):
    """Per part (column 0): exact links among its classes, as (digest, digest of the group's first class, rep_id, part id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_parts(batches):
            part = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                piece = batch.slice(a, b - a)
                digests = piece.column(1).to_pylist()
                first = np.array(sorted({d: i for i, d in reversed(list(enumerate(digests)))}.values()))
                if len(first) < len(digests):
                    piece = piece.take(pa.array(first))
                    digests = [digests[i] for i in first]
                texts = pa.array(piece.column(3).to_pylist(), pa.string())
                label = linked_groups(*shingle_sets(texts, words), num, den)
                reps = piece.column(2).to_pylist()
                least: dict[int, int | None] = {}
                for g, r in zip(label.tolist(), reps):
                    if r is not None and (least.get(g) is None or r < least[g]):
                        least[g] = r
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array([digests[g] for g in label], pa.binary()), pa.array([least.get(g) for g in label.tolist()], pa.int64()), piece.column(4)],
                    names=["digest", "head", "rep", "unit"],
                )

    return run


def _settle(rows: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Exact links of rows (part, digest, rep, text, unit), part by part."""
    dealt = rows.select("part", "digest", "rep", "text", "unit").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(freeing(_exact(words, num, den)), "digest binary, head binary, rep long, unit long")


def near_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id per row of ``docs``; links at den * |x & y| >= num * |x | y|."""
    small_batches(docs.sparkSession)
    rows = written(sketch(docs, words), "near-sketch")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = written(
        rows.filter("n_shingles > 0").groupBy("digest").agg(first, F.max("signature").alias("signature"), F.max("n_shingles").alias("n"))
        .select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "signature", "n"), "near-classes",
    )
    units = connected(candidate_links(classes, num / den))
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    members = written(
        classes.select("digest", "rep", "text_hash", "n", node.alias("node")).join(units, "node").select("digest", "rep", "text_hash", "n", F.col("root").alias("unit")),
        "near-members",
    )
    sizes = members.groupBy("unit").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("classes") / block_classes, F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    sizes = written(sizes.select("unit", "classes", blocks.alias("blocks")).filter("classes > 1"), "near-units")
    dealt = members.join(sizes, "unit").withColumn("draw", F.pmod(F.xxhash64("digest"), F.lit(1 << 40)))
    block = F.col("draw") % F.col("blocks")
    hub = F.floor(F.col("draw") / (1 << 20)) % F.greatest(F.floor(F.col("classes") / HUBS), F.lit(1)) == 0
    where = F.when((F.col("blocks") > 1) & hub, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), F.col("text").alias("text"))
    placed = dealt.withColumn("where", where)
    on = placed["rep"].eqNullSafe(texts["rep"]) & (placed["text_hash"] == texts["text_hash"])
    # Written once: large units read their members' texts again, and no others.
    found = written(placed.join(texts, on).select(placed["digest"], placed["rep"], placed["unit"], "where", texts["text"]), "near-texts")
    spread = found.select("digest", "rep", "unit", "text", F.explode("where").alias("b"))
    links = written(_settle(spread.withColumn("part", F.xxhash64("unit", "b")), words, num, den), "near-exact")
    large = sizes.filter("blocks > 1")
    groups = links.join(large, "unit", "left_anti").select("digest", F.col("rep").alias("component"))
    if not large.isEmpty():
        groups = groups.unionByName(_large_units(dealt, links, large, found, words, num, den, block_classes))
    named = written(
        classes.select("digest", "rep").join(groups, "digest", "left").select("digest", F.coalesce("component", "rep").alias("component")), "near-groups"
    )
    full = rows.select("doc_id", "text_hash", "n_shingles", "digest").filter("n_shingles > 0").join(named, "digest")
    out = full.select("doc_id", "text_hash", "n_shingles", F.col("component").alias("component_id"))
    return out.unionByName(rows.filter("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")))


def _large_units(dealt, links, large, texts, words, num, den, block_classes) -> DataFrame:
    """(digest, component) of the classes in units of several blocks."""
    inside = links.join(large, "unit", "left_semi").select(F.col("digest").alias("a"), F.col("head").alias("b"))
    stars = inside.filter("a <> b")
    here = dealt.join(large.select("unit"), "unit", "left_semi")
    grouped = written(
        here.join(connected(stars).withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest")), "near-grouped"
    )
    by_root = grouped.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("n"))
    main = by_root.groupBy("unit").agg(F.max_by("root", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    main = written(main.filter("others > 0").withColumn("tiles", F.ceil(F.col("others") / block_classes).cast("long")), "near-main")
    rest = grouped.join(main, "unit")
    outside = F.col("root") != F.col("main")
    own = rest.select("digest", "rep", "unit", F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: F.struct((F.col("draw") % F.col("blocks")).alias("b"), t.alias("t"))).alias("where"))
    tile = F.floor(F.col("draw") / (1 << 20)) % F.col("tiles")
    away = rest.filter(outside).select("digest", "rep", "unit", F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(b.alias("b"), tile.cast("long").alias("t"))).alias("where"))
    texts = texts.join(large.select("unit"), "unit", "left_semi").select("digest", "text")
    spread = own.unionByName(away).join(texts, "digest").select("digest", "rep", "unit", "text", F.explode("where").alias("w"))
    more = written(_settle(spread.withColumn("part", F.xxhash64("unit", "w.b", "w.t")), words, num, den), "near-tiles")
    stars = stars.unionByName(more.select(F.col("digest").alias("a"), F.col("head").alias("b")).filter("a <> b"))
    final = here.select("digest", "rep").join(connected(stars).withColumnRenamed("node", "digest"), "digest", "left")
    final = written(final.withColumn("root", F.coalesce("root", "digest")), "near-final")
    least = final.groupBy("root").agg(F.min("rep").alias("component")).select(apart("root").alias("r"), "component")
    return final.join(least, final["root"] == least["r"]).select("digest", "component")


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row with the smallest id of each group, with all columns of ``docs``; texts without words all stay."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    key, text = names["doc_id"], names["text"]
    groups = near_groups(docs.select("doc_id", "text"), words, num, den)
    stay = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h"), F.col("n_shingles").alias("_n")).distinct()
    left = docs.select(*(docs[c].alias(n) for c, n in names.items())).withColumn("_hash", F.xxhash64(text))
    out = left.join(stay, left[key].cast("long").eqNullSafe(stay["_id"]) & (left["_hash"] == stay["_h"]))
    # Rows that repeat an id and a text are one document; texts without words are nobody's copy.
    with_words, without = out.filter("_n > 0"), out.filter("_n = 0")
    return with_words.dropDuplicates([key, "_hash"]).unionByName(without).select(*(F.col(n).alias(c) for c, n in names.items()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir).select("doc_id", "text"), words=3, num=85)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
