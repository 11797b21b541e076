"""Merkle manifest of a dataset whose nodes keep SHA-256 midstates.

A leaf is the hash of a row's fields. The leaves of a part (``lang``), in
ascending order of doc_id, are the lowest level of an 8-ary tree; the subroots
of the parts are the leaves of a last tree, whose top is the root. A node is
the hash of the hex digests of its children. A hex digest is just one block of
SHA-256, so the state of the hash before each child is eight 32-bit words with
nothing buffered: a parent keeps a copy for each of its slots, and the copies
can be stored. To fold a changed child, the state before its slot is taken up
again and gets the replacement and the siblings on the right, none on the left.

Spark builds ``LEVELS`` levels in one job: a task has 8 ** LEVELS neighbouring
nodes of a part, however large the part is, and the tops of these bands are the
nodes of the next job. Ranks inside a part come from a range partition and the
row counts of the partitions. A band's nodes know the way (states and siblings)
to the root; the rows of a band meet that way once, not row by row. Texts are
read once, for the leaves, and never exchanged.

Defined cases: null fields are "-" in a leaf, so they differ from empty ones;
rows without a doc_id come first and are never tampered with; rows that repeat
a doc_id follow each other in the order of their leaves and each has its own
place; a part with one row has its leaf as subroot; a proof without siblings is
the hash of nothing; an empty table gives no rows; further columns are no part
of a leaf.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, ship_package, written

ARITY = 8
LEVELS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- SHA-256 over many messages at once -------------------------------------------------------


def _fraction_bits(root: int, n: int) -> np.ndarray:
    """First 32 bits of the fractions of the square or cube roots of the first ``n`` primes, as the standard sets them."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, int(p**0.5) + 1))][:n]
    out = []
    for p in primes:
        x = round((p << 32 * root) ** (1 / root))
        while x**root > p << 32 * root:
            x -= 1
        while (x + 1) ** root <= p << 32 * root:
            x += 1
        out.append(x & 0xFFFFFFFF)
    return np.array(out, np.uint32)


START, ROUND = _fraction_bits(2, 8), _fraction_bits(3, 64)
_HEX = np.frombuffer(bytes(range(256)).hex().encode(), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each."""
    w = list(np.ascontiguousarray(blocks.T))
    a, b, c, d, e, f, g, h = first = list(np.ascontiguousarray(states.T))
    for t in range(64):
        if t >= 16:
            x, y = w[t - 15], w[t - 2]
            w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        up = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + ROUND[t] + w[t]
        top = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = up + top, a, b, c, d + up, e, f, g
    return np.stack([x + y for x, y in zip(first, (a, b, c, d, e, f, g, h))], 1)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of bytes as the block (n, 16) that their hex text is."""
    return np.ascontiguousarray(_HEX[digests].reshape(len(digests), 64)).view(">u4").astype(np.uint32)


def finish(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of messages of ``children`` blocks, from the states after the last one."""
    pad = np.zeros((len(states), 16), np.uint32)
    pad[:, 0], pad[:, 15] = 0x80000000, 512 * children
    return compress(states, pad).astype(">u4").view(np.uint8).reshape(-1, 32)


# --- one level --------------------------------------------------------------------------------


class Level:
    """The parents of consecutive nodes (n, 32): their digests, and the state before each slot."""

    def __init__(self, nodes: np.ndarray):
        n = -(-len(nodes) // ARITY)
        self.nodes, self.blocks = nodes, hex_blocks(nodes)
        self.size = np.full(n, ARITY)
        self.size[-1] = len(nodes) - ARITY * (n - 1)
        self.states = np.zeros((n, ARITY, 8), np.uint32)
        state = np.tile(START, (n, 1))
        for slot in range(ARITY):
            self.states[:, slot] = state
            rows = np.flatnonzero(self.size > slot)
            if len(rows):
                state[rows] = compress(state[rows], self.blocks[ARITY * rows + slot])
        self.parents = finish(state, self.size)

    def fold(self, at: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """The parents as they are if node ``at[i]`` is replaced by ``digests[i]``, each replacement for itself."""
        parent, slot = at // ARITY, at % ARITY
        state = compress(self.states[parent, slot], hex_blocks(digests))
        for step in range(1, ARITY):
            rows = np.flatnonzero(slot + step < self.size[parent])
            if not len(rows):
                break
            state[rows] = compress(state[rows], self.blocks[at[rows] + step])
        return finish(state, self.size[parent])

    def siblings(self, at: int) -> tuple[bytes, bytes]:
        """Digests on the left and on the right of node ``at``."""
        first = at // ARITY * ARITY
        return self.nodes[first:at].tobytes(), self.nodes[at + 1 : first + ARITY].tobytes()


def band(nodes: np.ndarray, count: int, height: int) -> list[Level]:
    """The levels above ``nodes``, up to ``height`` and until the tree, which has ``count`` nodes here, has one."""
    levels = []
    while len(levels) < height and count > 1:
        levels.append(Level(nodes))
        nodes, count = levels[-1].parents, -(-count // ARITY)
    return levels


def resume(step: dict, digests: np.ndarray) -> np.ndarray:
    """Folds ``digests`` (n, 32) through one step of a stored way: its state, the replacement, the right siblings."""
    n = len(digests)
    state = np.tile(np.frombuffer(step["state"], "<u4").astype(np.uint32), (n, 1))
    state = compress(state, hex_blocks(digests))
    right = np.frombuffer(step["after"], np.uint8).reshape(-1, 32)
    for block in hex_blocks(right):
        state = compress(state, np.tile(block, (n, 1)))
    return finish(state, np.full(n, len(step["before"]) // 32 + 1 + len(right)))


# --- leaves and ranks -------------------------------------------------------------------------


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(row[c]) for c in FIELDS)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, nameless, name, leaf, changed): ``nameless`` and ``name`` are the part; ``changed`` is the tampered leaf, if any.

    Every third doc_id, by its hash, is tampered with: the capitals of its text become small.
    """
    row = {c: F.col(c) for c in FIELDS}
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = leaf(row | {"text": F.translate("text", CAPITALS, SMALL)})
    return written(
        docs.select(
            F.col("doc_id"), F.col("lang").isNull().alias("nameless"), F.coalesce("lang", F.lit("")).alias("name"), leaf(row).alias("leaf"),
            F.when(third & F.col("text").isNotNull(), changed).alias("changed"), F.monotonically_increasing_id().alias("_tie"),
        ), "merkle-leaves",
    )


def ranked(rows: DataFrame, part: list[str], order: list[str | Column]) -> DataFrame:
    """``rows`` with ``idx`` (0, 1, 2, ... in every part) and ``n`` (rows of the part), in the order ``order``, which begins with the part."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_split", F.shiftright("_at", 33)), "merkle-order")
    splits = dealt.groupBy(*part, "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row per part and partition, not per row
    before = Window.partitionBy(*part).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n": F.sum("_n").over(Window.partitionBy(*part))})
    out = dealt.join(splits.drop("_n"), [*part, "_split"])
    return out.withColumn("idx", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_split", "_first", "_start")


# --- trees ------------------------------------------------------------------------------------

_STEP = pa.struct([("state", pa.binary()), ("before", pa.binary()), ("after", pa.binary())])
_WAY = "array<struct<state:binary,before:binary,after:binary>>"


def _sorted(table: pa.Table) -> tuple[pa.Table, np.ndarray, int, int]:
    """The table in the order of idx, its digests, and the first idx and the count of the tree's nodes."""
    table = table.sort_by("idx").combine_chunks()
    nodes = np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)
    return table, nodes, table["idx"][0].as_py(), table["n"][0].as_py()


def _builder(part: list[str], kept: bool, height: int):
    """Rows of a band: (part, idx, up, way, top, left); with ``kept`` False its first node only, without a way."""
    width = ARITY**height

    def build(table: pa.Table) -> pa.Table:
        table, digests, first, count = _sorted(table)
        levels = band(digests, count, height)
        top = levels[-1].parents[0] if levels else digests[0]
        n, ways = len(table) if kept else 1, []
        for i in range(n if kept else 0):
            way, j = [], i
            for level in levels:
                before, after = level.siblings(j)
                way.append({"state": level.states[j // ARITY, j % ARITY].astype("<u4").tobytes(), "before": before, "after": after})
                j //= ARITY
            ways.append(way)
        out = [table[c].slice(0, n) for c in part] + [
            pa.array(first + np.arange(n)), pa.array(np.full(n, first // width)), pa.array(ways or [None], pa.list_(_STEP)),
            pa.array([top.tobytes()] + [None] * (n - 1), pa.binary()), pa.array(np.full(n, -(-count // width))),
        ]
        return pa.Table.from_arrays(out, names=[*part, "idx", "up", "way", "top", "left"])

    return build


def climb(nodes: DataFrame, part: list[str], keep: bool, height: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """Roots (part, digest) of the trees over ``nodes`` (part, idx, n, digest), and the written bands from below.

    A band has a row for each of its nodes: (part, idx, up, way) with ``up`` the
    idx of the band's top; with ``keep`` False the lowest one has its tops only.
    """
    width, bands = ARITY**height, []
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*part).schema)
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        cut = nodes.select(*part, "idx", "n", "digest", F.floor(F.col("idx") / width).alias("_band")).groupBy(*part, "_band")
        made = cut.applyInArrow(_builder(part, keep or bool(bands), height), f"{kinds}, idx long, up long, way {_WAY}, top binary, left long")
        bands.append(written(made, "merkle-band"))
        nodes = bands[-1].filter("top is not null").select(*part, F.col("up").alias("idx"), F.col("left").alias("n"), F.col("top").alias("digest"))
    return nodes.select(*part, "digest"), bands


def ways(bands: list[DataFrame], part: list[str]) -> DataFrame | None:
    """(part, idx, way) from every node of the lowest of ``bands`` to its root."""
    found = None
    for made in reversed(bands):
        if found is None:
            found = made.select(*part, "idx", "way")
            continue
        above = found.select(*part, F.col("idx").alias("up"), F.col("way").alias("_above"))
        found = made.select(*part, "idx", "up", "way").join(above, [*part, "up"]).select(*part, "idx", F.concat("way", "_above").alias("way"))
    return found


PART = ["nameless", "name"]


def manifest(rows: DataFrame, height: int = LEVELS) -> tuple[DataFrame, DataFrame, bytes | None]:
    """Ranked leaves; (part, band, subroot, way from the band's top to the root); the root.

    ``rows`` are leaves. A band is 8 ** height leaves of a part.
    """
    ship_package(rows.sparkSession)
    places = [F.col("nameless").desc(), F.col("name")]
    placed = written(ranked(rows, PART, [*places, F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]), "merkle-ranked")
    subroots, bands = climb(placed.select(*PART, "idx", "n", F.col("leaf").alias("digest")), PART, False, height)
    subroots = written(subroots, "merkle-subroots")
    one = F.lit(0).alias("_all")
    over = ranked(subroots.withColumn("_all", F.lit(0)), ["_all"], places).select(*PART, "digest", "idx", "n", one)
    over = written(over, "merkle-parts")
    tops, joints = climb(over.select("_all", "idx", "n", "digest"), ["_all"], True, height)
    root = tops.first()
    empty = F.array().cast(_WAY)
    last = ways(joints, ["_all"])
    parts = over.join(last, ["_all", "idx"], "left") if last is not None else over.withColumn("way", F.lit(None).cast(_WAY))
    parts = parts.select(*PART, F.col("digest").alias("subroot"), F.coalesce("way", empty).alias("_last"))
    inner = ways(bands[1:], PART)
    known = placed.select(*PART, F.floor(F.col("idx") / ARITY**height).alias("_band")).distinct()
    if inner is not None:
        known = known.join(inner.withColumnRenamed("idx", "_band"), [*PART, "_band"], "left")
    else:
        known = known.withColumn("way", F.lit(None).cast(_WAY))
    known = known.join(parts, PART).select(*PART, "_band", "subroot", F.concat(F.coalesce("way", empty), "_last").alias("way"))
    return placed, written(known, "merkle-ways"), bytes(root["digest"]) if root else None


def _prove(root: bytes, height: int):
    """Proof and folded root of every leaf of a band, from its leaves and the way of its top."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, digests, _, count = _sorted(rows)
        levels, n = band(digests, count, height), len(rows)
        way, subroot = above["way"][0].as_py(), above["subroot"][0].as_py()
        changed = rows["changed"].to_pylist()
        now = digests.copy()
        for i, c in enumerate(changed):
            if c is not None:
                now[i] = np.frombuffer(c, np.uint8)
        at = np.arange(n)
        beside = []
        for level in levels:
            now = level.fold(at, now)
            hexes = level.nodes.tobytes().hex()
            beside.append((hexes, at, at // ARITY * ARITY))
            at = at // ARITY
        upper = "".join((s["before"] + s["after"]).hex() for s in way).encode()
        proofs = []
        for i in range(n):
            h = hashlib.sha256()
            for hexes, mine, first in beside:
                a, b = 64 * int(first[i]), 64 * int(mine[i])
                h.update((hexes[a:b] + hexes[b + 64 : a + 64 * ARITY]).encode())
            h.update(upper)
            proofs.append(h.hexdigest())
        # rows that are the same at the band's top have the same way from there
        kinds, which = np.unique(now, axis=0, return_inverse=True)
        for step in way:
            kinds = resume(step, kinds)
        folded = [k.tobytes().hex() for k in kinds]
        ends = [folded[w] for w in which.reshape(-1)]
        hexed = root.hex()
        return pa.table({
            "doc_id": rows["doc_id"], "leaf": [d.hex() for d in rows["digest"].to_pylist()], "subroot": [subroot.hex()] * n, "root": [hexed] * n,
            "proof_sha256": proofs, "folded_root": ends, "verified": [e == hexed for e in ends],
        })

    return run


def verify(rows: DataFrame, height: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf row."""
    placed, above, root = manifest(rows, height)
    kind = placed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    mine = placed.select(*PART, F.floor(F.col("idx") / ARITY**height).alias("_band"), "idx", "n", "doc_id", F.col("leaf").alias("digest"), "changed")
    keys = [*PART, "_band"]
    return mine.groupBy(*keys).cogroup(above.groupBy(*keys)).applyInArrow(_prove(root or b"", height), schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(leaves(documents(spark, sf_dir)))


def _field_sql(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
    "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
)
_LEAF = "sha256(" + " || ".join(_field_sql(c) for c in FIELDS[:-1]) + " || %s)"
SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF % _field_sql('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN {_LEAF % _field_sql(f"translate(text, '{CAPITALS}', '{SMALL}')")} END AS changed
  FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS rid FROM l),
up AS (SELECT lang, 0 AS lv, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM r
  UNION ALL SELECT lang, lv + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY lang, lv, idx // 8),
nodes AS MATERIALIZED (SELECT * FROM up),
s AS MATERIALIZED (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
over_ AS (SELECT 0 AS lv, idx, subroot AS h, count(*) OVER () AS n FROM s
  UNION ALL SELECT lv + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), (any_value(n) + 7) // 8 FROM over_ WHERE n > 1 GROUP BY lv, idx // 8),
all_ AS MATERIALIZED (SELECT coalesce('=' || lang, '-') AS tree, lv, idx, h, n FROM nodes UNION ALL SELECT 'top', lv, idx, h, n FROM over_),
walk AS (SELECT rid, coalesce('=' || lang, '-') AS tree, 0 AS lv, idx, coalesce(changed, leaf) AS cur, '' AS proof FROM r
  UNION ALL SELECT rid, w.tree, w.lv + 1, w.idx // 8, sha256(string_agg(CASE WHEN a.idx = w.idx THEN cur ELSE h END, '' ORDER BY a.idx)),
      any_value(proof) || coalesce(string_agg(h, '' ORDER BY a.idx) FILTER (a.idx <> w.idx), '')
    FROM walk w JOIN all_ a ON a.tree = w.tree AND a.lv = w.lv AND a.idx // 8 = w.idx // 8 AND a.n > 1 GROUP BY rid, w.tree, w.lv, w.idx),
low AS MATERIALIZED (SELECT rid, arg_max(cur, lv) AS cur, arg_max(proof, lv) AS proof FROM walk GROUP BY rid),
high AS (SELECT rid, 0 AS lv, s.idx, cur, proof FROM low JOIN r USING (rid) JOIN s ON s.lang IS NOT DISTINCT FROM r.lang
  UNION ALL SELECT rid, w.lv + 1, w.idx // 8, sha256(string_agg(CASE WHEN a.idx = w.idx THEN cur ELSE h END, '' ORDER BY a.idx)),
      any_value(proof) || coalesce(string_agg(h, '' ORDER BY a.idx) FILTER (a.idx <> w.idx), '')
    FROM high w JOIN all_ a ON a.tree = 'top' AND a.lv = w.lv AND a.idx // 8 = w.idx // 8 AND a.n > 1 GROUP BY rid, w.lv, w.idx),
top AS (SELECT rid, arg_max(cur, lv) AS cur, arg_max(proof, lv) AS proof FROM high GROUP BY rid)
SELECT r.doc_id, r.leaf, s.subroot, x.h AS root, sha256(top.proof) AS proof_sha256, top.cur AS folded_root, top.cur = x.h AS verified
FROM r JOIN top USING (rid) JOIN s ON s.lang IS NOT DISTINCT FROM r.lang, (SELECT h FROM all_ WHERE tree = 'top' AND n = 1) x
"""
