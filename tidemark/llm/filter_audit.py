"""What filters remove in every order in which they could run.

A filter is stored as a relation: the ids of the documents that fail it. What a
prefix of filters leaves is a left-anti join of all ids with the relations of
the prefix; what the next filter removes is a left-semi join of these survivors
with its relation; what it fails but finds removed already (redundant) is a
left-semi join of its own relation with those of the prefix; what it alone
fails is a left-anti join with the other relations. Survivors depend on the set
of a prefix and not on its order, so every set of filters is one tag of the
same joins, not a plan of its own.

Rows get a number when the scanned table is written, which is their id in all
relations. All joins share that key, so ids and relations are exchanged once
and no key is hot, whatever doc_id is. A document that fails no filter survives
every prefix; it is counted and takes no part in the tagged joins.

Defined cases: a null text is an empty one, a null part is the empty string
(and one with it); rows without doc_id have no labels, are no copies and have
none; rows that repeat a doc_id are documents of their own, of which none is
a copy by the other's text, as no id is smaller; a label counts if any row of
``labels`` with that doc_id has it; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .labels import labels_of

SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key with at least this share of the rows is hot; there are at most HOT of them, so they may be broadcast.
HOT = 1024
#: Filters of one audit; it lists all orders of them.
MOST_FILTERS = 7


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": n_words < 200,
        "B": 100 * n_distinct < 50 * n_words,
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


# --- joins with keys that may be hot ----------------------------------------------------------


def beside(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, which has one row per key.

    Keys with a share of 1 / HOT of the rows of ``left`` are joined in place by
    a broadcast of their at most HOT rows; only the others are exchanged.
    """
    total = left.count()
    many = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = written(many.filter(F.col("_n") * HOT >= total).select(key), "audit-hot")
    some = left.filter(F.col(key).isNotNull())
    out = some.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, how)
    out = out.unionByName(some.join(F.broadcast(hot), key, "left_anti").join(right, key, how))
    if how == "left":
        out = out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    return out


# --- relations --------------------------------------------------------------------------------


def scan(docs: DataFrame, part: str = "lang") -> DataFrame:
    """One narrow row per document: rid, doc_id, part, digest of the text and the conditions on the text alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    return written(rows.select("rid", "doc_id", "part", digest, *(c.alias(f"fails_{n}") for n, c in text_conditions(F.col("text")).items())), "audit-scan")


def later_copies(scanned: DataFrame) -> DataFrame:
    """(rid) of the documents whose text occurs with a smaller doc_id too."""
    known = scanned.filter("doc_id is not null").select("rid", "doc_id", "digest")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return beside(known, written(first.select("digest", "first"), "audit-first"), "digest", "inner").filter("doc_id > first").select("rid")


def labelled(scanned: DataFrame, labels: DataFrame) -> DataFrame:
    """(rid, part, good, toxic) of every document."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    out = beside(scanned.select("rid", "doc_id", "part"), marks, "doc_id", "left")
    return out.select("rid", "part", *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")))


def text_relations(docs: DataFrame, labels: DataFrame, part: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """All ids with part and labels, and the stored id table of every filter A to E."""
    scanned = scan(docs, part)
    fails = {n: scanned.filter(f"fails_{n}").select("rid") for n in "ABCD"} | {"E": later_copies(scanned)}
    return written(labelled(scanned, labels), "audit-ids"), {n: written(f, f"audit-fails-{n}") for n, f in fails.items()}


# --- the audit --------------------------------------------------------------------------------


def audit(ids: DataFrame, fails: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step.

    ``ids`` (rid, part, good, toxic) names every document once; ``fails`` maps
    the name of a filter, one letter, to the ids (rid) that fail it.
    """
    names = sorted(fails)
    if not 1 <= len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with names of one letter")
    bit = {n: 1 << i for i, n in enumerate(names)}
    whole = (1 << len(names)) - 1
    relation = None
    for n in names:
        tagged = fails[n].select("rid", F.lit(bit[n]).alias("by"))
        relation = tagged if relation is None else relation.unionByName(tagged)
    every = relation.select(F.col("rid").alias("_rid"), F.col("by").alias("_by"))
    same, count = F.col("rid") == F.col("_rid"), F.count(F.lit(1))

    dirty, clean = (ids.join(relation, "rid", how) for how in ("left_semi", "left_anti"))
    alive = dirty.withColumn("past", F.explode(F.sequence(F.lit(0), F.lit(whole))))
    for n in names:
        gone = fails[n].select(F.col("rid").alias("_rid"))
        alive = alive.join(gone, same & (F.col("past").bitwiseAND(bit[n]) != 0), "left_anti")
    kept = alive.groupBy("part", "past").agg(count.alias("_kept"))

    bits = F.array(*[F.lit(b) for b in bit.values()])
    ahead = alive.withColumn("by", F.explode(F.filter(bits, lambda b: F.col("past").bitwiseAND(b) == 0)))
    removed = ahead.join(every, same & (F.col("by") == F.col("_by")), "left_semi").groupBy("part", "past", "by").agg(
        count.alias("_removed"), F.count_if("good").alias("_good"), F.count_if("toxic").alias("_toxic")
    )
    failing = dirty.select("rid", "part", F.explode(bits).alias("by")).join(every, same & (F.col("by") == F.col("_by")), "left_semi")
    pasts = F.filter(F.sequence(F.lit(0), F.lit(whole)), lambda s: s.bitwiseAND(F.col("by")) == 0)
    found_gone = failing.withColumn("past", F.explode(pasts)).join(every, same & (F.col("past").bitwiseAND(F.col("_by")) != 0), "left_semi")
    redundant = found_gone.groupBy("part", "past", "by").agg(count.alias("_redundant"))
    alone = failing.join(every, same & (F.col("by") != F.col("_by")), "left_anti").groupBy("part", "by").agg(count.alias("_alone"))

    steps = [("".join(o), i + 1, sum(bit[n] for n in o[:i]), bit[o[i]]) for o in permutations(names) for i in range(len(names))]
    kind = "array<struct<filter_order:string,step:int,past:int,by:int>>"
    grid = F.from_json(F.lit("[" + ",".join('{"filter_order":"%s","step":%d,"past":%d,"by":%d}' % s for s in steps) + "]"), kind)
    parts = ids.select("part").distinct().join(clean.groupBy("part").agg(count.alias("_clean")), "part", "left")
    out = parts.select("part", "_clean", F.inline(grid)).withColumn("_after", F.col("past").bitwiseOR(F.col("by")))
    out = out.join(kept.withColumnRenamed("past", "_after"), ["part", "_after"], "left").join(removed, ["part", "past", "by"], "left")
    out = out.join(redundant, ["part", "past", "by"], "left").join(alone, ["part", "by"], "left").fillna(0)
    return out.select(
        "part", "filter_order", "step", (F.col("_kept") + F.col("_clean")).alias("kept"), F.col("_removed").alias("removed"),
        F.col("_redundant").alias("redundant"), F.col("_alone").alias("unique_fails"), F.col("_good").alias("good_lost"),
        F.col("_toxic").alias("toxic_lost"), F.sum("_removed").over(Window.partitionBy("part", "by")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(*text_relations(documents(spark, sf_dir), labels_of(spark, sf_dir)))


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT rid, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        map {{'A': len(words) < 200, 'B': 100 * list_unique(words) < 50 * len(words),
             'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), 'D': regexp_matches(text, '[#$%&*|]'),
             'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)}} AS fails
      FROM w LEFT JOIN m ON w.doc_id = m.doc_id),
s AS (SELECT o AS filter_order, i AS step, o[i] AS filter, o[1:i - 1] AS earlier FROM (VALUES {_ORDERS}) t(o), range(1, 6) r(i)),
x AS (SELECT part, filter_order, step, filter, good, toxic, fails[filter] AS failing,
        list_bool_or(list_transform(string_split(earlier, ''), lambda c: coalesce(fails[c], false))) AS gone,
        list_bool_or(list_transform(list_filter(['A', 'B', 'C', 'D', 'E'], lambda c: c <> filter), lambda c: fails[c])) AS others
      FROM f, s),
g AS (SELECT part, filter_order, step, filter, count(*) FILTER (NOT gone AND NOT failing) AS kept,
        count(*) FILTER (failing AND NOT gone) AS removed, count(*) FILTER (failing AND gone) AS redundant,
        count(*) FILTER (failing AND NOT others) AS unique_fails, count(*) FILTER (failing AND NOT gone AND good) AS good_lost,
        count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost
      FROM x GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM g
"""
