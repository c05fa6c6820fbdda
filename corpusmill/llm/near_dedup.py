"""MinHash near-deduplication with an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of distinct word shingles, and the set becomes
   `trees * depth` MinHash values.  Equal sets are one class, represented by
   its smallest id; only representatives go on.
2. Each tree orders the representatives by its own run of MinHash values: the
   first `depth` of them are the region, the next four the place in it.  A row is
   a candidate with the row before it in that order (their common prefix is the
   longest).  Regions of more than `region_rows` rows are
   ordered in parts, by one more value at a time.
3. Candidates whose signatures agree on a share of `loose` at least are compared
   on their full sets, each row first with its best one.  Not compared are those whose
   sets differ in more shingles than a link allows: the parity of the number of
   shingles in each of 512 hash buckets differs no more often than the sets do.  The links label
   components, and only candidates of two components are compared after that.
   Then regions with several components are walked again, once in their own order and,
   with the components known by then, once in that of another tree's values: a row is a
   candidate with the nearest row on either side that is of another component,
   with those of the `near` rows before it, and of the smallest ids of its region and
   of its prefixes of one, two and four values more, that are.  What is found is
   compared in the same way: best ones first, then all that is left between components.

Work is linear in the rows: a row gives one candidate a tree in the first walk
and `near` + 6 in each later one, however large its region or component.
Nothing is held for a group: texts are compared pair by pair.  Two texts with
similarity s share no region with a chance of (1 - s**depth)**trees: 3e-6 at 0.8, and
their signatures agree on less than `loose` with one of 2e-6.
That they share one but are never neighbours, nor joined by others, is seen
only for texts with hardly a link (the README has figures against all pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, compact
from .components import connected_components
from .wordhash import BASE_WORDS, hash_words, mix, rolling, runs

RUN_BYTES = 1 << 20
PARITY_BITS = 512


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct `width`-word shingles of each lower-cased text."""
    hashes, counts = hash_words([t.lower() for t in texts])
    rolled = rolling(hashes, width, BASE_WORDS[0])
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        else:  # fewer words: the whole sequence is one shingle
            out.append(rolling(hashes[at : at + n], n, BASE_WORDS[0]) if n else np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash values (uint32) of non-empty sets, one row each."""
    rng = np.random.default_rng(20240607)
    times, plus = (rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(2))
    times = times * np.uint64(2) + np.uint64(1)
    values, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), size), np.uint32)
    for j in range(size):
        out[:, j] = np.minimum.reduceat(((values ^ plus[j]) * times[j]) >> np.uint64(32), starts)
    return out


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, whether the number of its elements is odd in each of PARITY_BITS hash buckets, as packed bits."""
    out = np.zeros((len(sets), PARITY_BITS), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((mix(s, 9) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(out, axis=1)


def _features(width: int, trees: int, depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [(t or "").encode() for t in rows["body"]]
            for a, b in runs([len(t) for t in texts], RUN_BYTES):
                sets = shingle_sets(texts[a:b], width)
                some = [i for i, s in enumerate(sets) if len(s)]
                n = b - a
                keys, deep, marks = np.zeros((n, trees), np.int64), np.zeros((n, trees), np.int64), np.zeros((n, 2), np.int64)
                sig = np.zeros((n, trees * depth), np.uint32)
                if some:
                    sig[some] = signatures([sets[i] for i in some], trees * depth)
                    marks[some] = [[int(mix(sets[i], 3 + j).sum(dtype=np.uint64).astype(np.int64)) for j in range(2)] for i in some]
                    wide = sig.astype(np.uint64)
                    for t in range(trees):
                        key = np.full(n, t + 1, np.uint64)
                        for j in range(depth):
                            key = mix(key ^ (wide[:, t * depth + j] << np.uint64(8)), 1)
                        keys[:, t] = key.astype(np.int64)
                        place = np.zeros(n, np.uint64)
                        for j in range(4):
                            place = (place << np.uint64(16)) | (wide[:, (t * depth + depth + j) % (trees * depth)] >> np.uint64(16))
                        deep[:, t] = place.astype(np.int64)
                small = (sig & np.uint32(15)).astype(np.uint8)
                packed = (small[:, ::2] << np.uint8(4)) | small[:, 1::2]
                yield pd.DataFrame({"id": rows["id"].iloc[a:b].to_numpy(), "text_key": rows["text_key"].iloc[a:b].to_numpy(), "n": [len(s) for s in sets], "mark": marks[:, 0], "mark2": marks[:, 1], "keys": list(keys), "deep": list(deep), "sketch": [x.tobytes() for x in packed], "parity": [x.tobytes() for x in parities(sets)]})

    return run


def _members(forest: DataFrame) -> DataFrame:
    """Rows of `forest` (id, n, key, deep, other_deep) whose region has more than one, with its size."""
    return forest.withColumn("rows", F.count("*").over(Window.partitionBy("key"))).where("rows > 1")


def _parts(region_rows: int, deep: str):
    """Large regions are ordered in parts, by one more 16-bit value for each factor of region_rows; equal places then by id."""
    return (
        F.when(F.col("rows") <= region_rows, F.lit(0).cast("long"))
        .when(F.col("rows") <= region_rows * 16, F.shiftrightunsigned(deep, 48))
        .when(F.col("rows") <= region_rows * 256, F.shiftrightunsigned(deep, 32))
        .otherwise(F.xxhash64(deep, F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / (region_rows * 256)))))
    )


def _pairs(rows: DataFrame, others: list, percent: int) -> DataFrame:
    """Candidates (a, b, ca, cb) of each row, `me`, with `others`: (id, component, n) each, n allowing a link."""
    wide = rows.select("me", *[o.alias(f"other{i}") for i, o in enumerate(others)])
    each = F.explode(F.array_distinct(F.array(*[f"other{i}" for i in range(len(others))]))).alias("other")
    apart = wide.select("me", each).where("other.id <> me.id").where(100 * F.least("me.n", "other.n") >= percent * F.greatest("me.n", "other.n"))
    ends = apart.select(F.sort_array(F.array("me", "other")).alias("p"))
    return ends.select(*[F.col(f"p.{field}")[i].alias(f"{name}{x}") for field, name in (("id", ""), ("component", "c")) for i, x in enumerate("ab")]).distinct()


def _first_walk(members: DataFrame, region_rows: int, percent: int) -> DataFrame:
    """Candidates (a, b): each row with the one before it, whose common prefix is the longest."""
    rows = members.withColumn("part", _parts(region_rows, "deep")).withColumn("me", F.struct("id", F.col("id").alias("component"), "n"))
    before = F.lag("me").over(Window.partitionBy("key", "part").orderBy("deep", "id"))
    return _pairs(rows, [before], percent).select("a", "b")


def _later_walk(members: DataFrame, deep: str, region_rows: int, near: int, percent: int) -> DataFrame:
    """Candidates (a, b) of different components (ca, cb) in regions that hold several, in the order of `deep`."""
    mixed = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    rows = members.join(mixed, "key", "left_semi").withColumn("part", _parts(region_rows, deep)).withColumn("me", F.struct("id", "component", "n"))
    order, back = (Window.partitionBy("key", "part").orderBy(*o) for o in ((deep, "id"), (F.desc(deep), F.desc("id"))))
    # The nearest row on either side of another component: the end of the run before, the start of the run after.
    rows = rows.withColumns({f"turn{i}": F.when(F.lag("component").over(w) != F.col("component"), F.lag("me").over(w)) for i, w in enumerate((order, back))})
    others = [F.last(f"turn{i}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i, w in enumerate((order, back))]
    others += [F.when(F.lag("component", k).over(order) != F.col("component"), F.lag("me", k).over(order)) for k in range(1, near + 1)]
    # The smallest id of the region and of each longer prefix, where it is of another component.
    prefixes = [["key"], *[["key", "part", F.shiftrightunsigned(deep, bits)] for bits in (48, 32, 0)]]
    heads = [F.min("me").over(Window.partitionBy(*p)) for p in prefixes]
    others += [F.when(h["component"] != F.col("component"), h) for h in heads]
    return _pairs(rows, others, percent)


def _agreement(x, y, values: int):
    """Share of equal 4-bit values in two sketches, less what chance gives."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        d = p ^ q
        same = ((d & 15) == 0).sum(1) + ((d >> 4) == 0).sum(1)
        return pd.Series((same / values - 1 / 16) * 16 / 15)

    return share(x, y)


def _differences(x, y):
    """Buckets whose parities differ: no more than the sets differ in elements."""

    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="int64")
        p, q = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
        return pd.Series(np.bitwise_count(p ^ q).sum(1, dtype=np.int64))

    return count(x, y)


def _linked(width: int, percent: int):
    """Whether 100 * intersection >= percent * union for the shingle sets of two texts."""

    def sets_of(texts: pd.Series) -> Iterator[np.ndarray]:
        data = [t.encode() for t in texts]
        for a, b in runs([len(t) for t in data], RUN_BYTES):
            yield from shingle_sets(data[a:b], width)

    @F.pandas_udf("boolean")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(sets_of(left), sets_of(right), strict=True):
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    return run


def near_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = 24, depth: int = 4, loose: float = 0.58, near: int = 4, region_rows: int = 4096) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of `docs`.

    Texts are lower-cased (A-Z); a text's set is its distinct `width`-word
    shingles, with fewer words the whole sequence as one.  Linked are sets with
    100 * intersection >= percent * union; the threshold itself links.  Null, empty and blank texts have an empty
    set and are linked with nothing; a null id is linked with nothing, is its own
    component (null) and kept.  Rows that repeat an id each come back once; the id is
    linked with whatever any of its texts is linked with, so the order of rows plays
    no part.  A text of any length is compared whole.  An empty table gives an empty
    one.  Other columns, whatever their names, play no part.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).withColumn("text_key", F.xxhash64("body"))
    features = checkpointed(source.mapInPandas(_features(width, trees, depth), "id long, text_key long, n long, mark long, mark2 long, keys array<long>, deep array<long>, sketch binary, parity binary"))
    same = ["n", "mark", "mark2"]
    whole = features.where("n > 0 and id is not null")
    classes = whole.groupBy(*same).agg(F.min("id").alias("rep"))
    member = whole.select("id", *same).distinct().join(classes, same).groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.collect_set("rep").alias("reps"))
    # An id with several texts belongs to several classes, which it ties together.
    tied = member.where("rep <> last").select(F.col("rep").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    reps = whole.join(classes, same).where("id = rep").groupBy("id", *same).agg(F.min("text_key").alias("text_key"), F.first("keys").alias("keys"), F.first("deep").alias("deep"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    reps = checkpointed(reps.drop("mark", "mark2"))
    turned = F.concat(F.slice("deep", trees // 2 + 1, trees), F.slice("deep", 1, trees // 2))
    forest = reps.select("id", "n", F.explode(F.arrays_zip("keys", "deep", turned.alias("turned"))).alias("t")).select("id", "n", F.col("t.keys").alias("key"), F.col("t.deep").alias("deep"), F.col("t.turned").alias("other_deep"))
    members = checkpointed(_members(forest))
    sketches = reps.select("id", "sketch", "parity", "n")

    def likely(edges: DataFrame) -> DataFrame:
        """`edges` whose sketches agree, how far, and whether sizes and parities make a link possible."""
        sides = [sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"), F.col("parity").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab"]
        both = edges.join(sides[0], "a").join(sides[1], "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        # |A - B| + |B - A| is (100 - percent) / (100 + percent) of |A| + |B| at most where sets link.
        possible = (100 + percent) * _differences(F.col("pa"), F.col("pb")) <= (100 - percent) * (F.col("na") + F.col("nb"))
        scored = both.select(*edges.columns, _agreement(F.col("sa"), F.col("sb"), trees * depth).alias("agreement"), possible.alias("possible"))
        # Filtered after the aggregate: before it, the sketches would be compared twice.
        return scored.groupBy(*edges.columns).agg(F.max("agreement").alias("agreement"), F.max("possible").alias("possible")).where(F.col("agreement") >= loose)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (a, b, ca, cb) whose texts link."""
        sides = [texts.select(F.col("id").alias(x), F.col("body").alias(f"text_{x}")) for x in "ab"]
        return pairs.select("a", "b", "ca", "cb").join(sides[0], "a").join(sides[1], "b").where(_linked(width, percent)("text_a", "text_b")).select("ca", "cb")

    def labelled(frame: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
        return frame.join(labels.select(F.col("node").alias(node), F.col("component").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        """`labels` with the components that `links` (ca, cb) connect made one."""
        roots = connected_components(links, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("root"))
        # A component that `labels` do not have is a row alone.
        both = labels.join(roots, "component", "full")
        return compact(both.select(F.coalesce("node", "component").alias("node"), F.coalesce("root", "component").alias("component")))

    def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        return labelled(labelled(pairs.select("a", "b", "agreement"), labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")

    def settled(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """`labels` after all of `pairs` (a, b, agreement, ca, cb) between components are compared, the best of each row and of each component first."""
        whole = F.struct("agreement", "a", "b", "ca", "cb")
        ends = pairs.select(whole.alias("e"), F.explode(F.array("a", "b", "ca", "cb")).alias("node"))
        best = compact(ends.groupBy("node").agg(F.max("e").alias("e")).select("e.*").distinct())
        labels = merged(labels, confirmed(best))
        rest = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti")
        return merged(labels, confirmed(compact(between(rest, labels))))

    first = compact(likely(_first_walk(members, region_rows, percent)))
    touched = compact(first.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    wanted = reps.join(touched, "id", "left_semi").select("id", "text_key")
    texts = checkpointed(source.join(wanted, ["id", "text_key"], "left_semi").groupBy("id", "text_key").agg(F.first("body").alias("body")).select("id", "body"))
    tie = compact(connected_components(tied, "a", "b"))
    final, seen = settled(tie, compact(between(first.where("possible"), tie))), first.select("a", "b")
    members = compact(members.join(touched, "id", "left_semi"))
    for deep in ("deep", "other_deep"):
        walk = _later_walk(labelled(members, final, "id", "component"), deep, region_rows, near, percent)
        found = compact(likely(walk.join(seen, ["a", "b"], "left_anti")))
        final, seen = settled(final, found.where("possible")), seen.unionByName(found.select("a", "b"))
    joined = labelled(member.select("id", "rep"), final, "rep", "component").select("id", "component")
    out = features.select("id", "n").join(joined, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
