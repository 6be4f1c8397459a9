"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

1. One pass over the texts hashes every word shingle once. The hash chooses a bin and competes in it
   (one permutation instead of one per bin). Empty bins borrow from a non-empty one along a fixed
   random walk of bins (optimal densification). Runs of bins are bands.
2. Documents with equal sets form one class; only its smallest id goes on.
3. Within a band bucket every class is a candidate of the smallest one: a star, so a bucket of n gives
   n - 1 candidates. Candidates are confirmed on the full sets, first one per class, then those that
   still join different components.
4. A star can miss a link between two classes that are both unlike its centre. Members of buckets that
   still hold several components are therefore dealt anew, by the rare shingles of their full sets: two
   sets that are similar enough share one of their few rarest shingles, so texts that have only a
   widespread passage in common part here. In a group that holds several components members become
   centres, 1, 8, 64, ... of them, until it has one component or every member that can be the smaller
   set of a link has been a centre. No pair that may be linked stays unchecked, and no group is capped.

Only candidates' sets are shuffled; texts are not, unless the candidates are too many to broadcast
their ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.components import components
from llm.shared import free_name, keep, keep_table, maybe_broadcast, packed
from llm.words import NOT_SPACE, hashes, mix, shingles, slices, split

#: At ``MEANT`` percent; see ``bands_for``.
BANDS = 24
ROWS = 5
MEANT = 85
WALK = 512
HOT = 1_000


def bands_for(percent: int, rows: int = ROWS) -> int:
    """The fewest bands by which a pair at ``percent`` shares none with at most the chance that ``BANDS`` bands of ``ROWS``
    leave at ``MEANT``; one at 100 %."""
    chance = BANDS * math.log1p(-((MEANT / 100) ** ROWS))
    return 1 if percent >= 100 else math.ceil(chance / math.log1p(-((percent / 100) ** rows)) - 1e-9)


def _walk(bins: int) -> np.ndarray:
    """WALK random bins for each bin, then all bins in turn, so that the walk always ends."""
    rng = np.random.Generator(np.random.PCG64(977))
    walk = rng.integers(0, bins, (WALK, bins))
    turn = (np.arange(1, bins)[:, None] + np.arange(bins)[None, :]) % bins
    return np.vstack([walk, turn])


def signatures(found: np.ndarray, row: np.ndarray, rows: int, bins: int, walk: np.ndarray) -> np.ndarray:
    """One-permutation min-hashes, rows x bins; all ones for rows without shingles."""
    none = np.uint64(2**64 - 1)
    out = np.full(rows * bins, none)
    slot = ((found >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    np.minimum.at(out, row * bins + slot.astype(np.int64), mix(found))
    out = out.reshape(rows, bins)
    filled = out != none
    lacking, column = np.nonzero(~filled & filled.any(axis=1)[:, None])
    step = 0
    while len(lacking):
        donor = walk[step][column]
        ok = filled[lacking, donor]
        out[lacking[ok], column[ok]] = out[lacking[ok], donor[ok]]
        lacking, column = lacking[~ok], column[~ok]
        step += 1
    return out


def _sets(data, offsets, size: int) -> tuple[np.ndarray, np.ndarray]:
    words = split(data, offsets, NOT_SPACE)
    found, at = shingles(hashes(data, words.starts, words.ends), words.of, size, whole_if_short=True)
    return found, np.searchsorted(at, words.of)


def sketch(docs: DataFrame, text: str, key: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, print: 128 bits of the set, bands)."""
    bins = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walk(bins)
        weights = mix(np.arange(1, bins + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                found, of = _sets(data, offsets, size)
                n = last - first
                count, a, b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                second = mix(found ^ np.uint64(0xA5A5A5A55A5A5A5A))
                for i in range(n):
                    one, where = np.unique(found[of[i] : of[i + 1]], return_index=True)
                    count[i] = len(one)
                    a[i] = one.sum(dtype=np.uint64)
                    b[i] = second[of[i] : of[i + 1]][where].sum(dtype=np.uint64)
                signs = signatures(found, np.repeat(np.arange(n), np.diff(of)), n, bins, walk)
                keys = mix((signs * weights).reshape(n, bands, rows).sum(axis=2, dtype=np.uint64) + weights[:bands])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(count), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists],
                    ["id", "n", "a", "b", "bands"],
                )

    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "id bigint, n bigint, a bigint, b bigint, bands array<bigint>"
    )


def full_sets(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """(id, found: the distinct shingle hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                found, of = _sets(data, offsets, size)
                sets = [np.unique(found[of[i] : of[i + 1]]) for i in range(last - first)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["id", "found"],
                )

    return docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, "id bigint, found array<bigint>"
    )


def _classes(usable: DataFrame) -> DataFrame:
    """(id, rep): the smallest id with the same set. Sets of a ``HOT``-th of all rows or more are at most ``HOT`` and
    joined by broadcast, so the shuffled join has no hot key."""
    same = ["n", "a", "b"]
    rows = usable.select("id", *same)
    total = rows.count()
    several = packed(rows.groupBy(*same).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("often")).filter("often > 1"))
    hot = several.filter(F.col("often") * HOT >= total).select(*same, F.col("least").alias("hot"))
    other = several.filter(F.col("often") * HOT < total).select(*same, "least")
    known = rows.join(F.broadcast(hot), same, "left")
    return (
        known.filter("hot IS NOT NULL")
        .select("id", F.col("hot").alias("rep"))
        .unionByName(known.filter("hot IS NULL").join(maybe_broadcast(other), same, "left").select("id", F.coalesce("least", "id").alias("rep")))
        .distinct()
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the candidate pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("u"), F.col("found").alias("fu"))
    right = sets.select(F.col("id").alias("v"), F.col("found").alias("fv"))
    return (
        pairs.join(left, "u")
        .join(right, "v")
        .withColumn("both", F.size(F.array_intersect("fu", "fv")))
        .filter(100 * F.col("both") >= percent * (F.size("fu") + F.size("fv") - F.col("both")))
        .select("u", "v")
    )


def rare_groups(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, n, rest, few): each set of ``sets(id, found)`` under its rarest shingles, those in no other
    set left out; ``rest`` counts the shingles from this one on. Two similar sets share at most ``rest``
    shingles if this is the rarest that they share, so it must be at least n * percent / 100, and for the
    smaller set of the two at least 2 * n * percent / (100 + percent) (``few``). Shingles in a ``HOT``-th of all rows or more are at most ``HOT`` and
    joined by broadcast, so the shuffled join has no hot key."""
    rows = sets.select("id", F.size("found").alias("n"), F.explode("found").alias("bucket"))
    counts = keep(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"))
    total = sets.agg(F.sum(F.size("found"))).first()[0] or 0
    hot = counts.filter(F.col("often") * HOT >= total).select("bucket", F.col("often").alias("hot"))
    other = counts.filter(F.col("often") * HOT < total)
    known = rows.join(F.broadcast(hot), "bucket", "left")
    placed = known.filter("hot IS NOT NULL").select("id", "n", "bucket", F.col("hot").alias("often")).unionByName(
        known.filter("hot IS NULL").drop("hot").join(other, "bucket").select("id", "n", "bucket", "often")
    )
    # Shingles in no other set come first in the order; they only take places.
    ordered = placed.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "bucket"))).alias("shared"))
    return (
        ordered.select("id", "n", (F.col("n") - F.size("shared")).alias("before"), F.posexplode("shared"))
        .select(F.col("col.bucket").alias("bucket"), "id", "n", (F.col("n") - F.col("before") - F.col("pos")).alias("rest"))
        .filter(f"100 * rest >= {percent} * n")
        .withColumn("few", F.expr(f"{100 + percent} * rest >= {2 * percent} * n"))
    )


def near_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    size: int = 5,
    percent: int = 85,
    bands: int | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """Link documents whose ``size``-word shingle sets have a Jaccard similarity of ``percent`` or more.

    ``bands`` follows from ``percent`` and ``rows`` if it is not given. Returns per row of ``docs``: key, n_shingles, n_links (confirmed links of its class to other
    classes), component_id (smallest key reachable), kept (whether it is that document).

    ``key`` must be an integer. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case. A text of fewer
    words than ``size`` is one shingle; null, empty and blank texts have an empty set and are linked
    with nothing. Rows with a null key take no part in links: component_id null, kept true. Repeated
    rows (same key) get the same component and are all kept or all dropped. Other columns are ignored.
    """
    spark = docs.sparkSession
    found = keep_table(sketch(docs, text, key, size, bands_for(percent, rows) if bands is None else bands, rows))
    usable = found.filter("n > 0 AND id IS NOT NULL")
    member = keep(_classes(usable))
    reps = member.filter("id = rep").select("id").distinct()
    buckets = usable.join(maybe_broadcast(keep(reps)), "id", "left_semi").select("id", "n", F.explode("bands").alias("bucket")).distinct()
    centres = buckets.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size"))
    crowded = packed(buckets.join(centres.filter("size > 1"), "bucket"))

    # Sizes alone rule out many candidates.
    def alike(a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"

    centre = crowded.filter("id = centre").select("bucket", F.col("n").alias("m"))
    stars = packed(
        crowded.filter("id <> centre")
        .join(centre, "bucket")
        .filter(alike("n", "m"))
        .groupBy(F.col("centre").alias("u"), F.col("id").alias("v"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    wanted = packed(crowded.select("id").distinct())
    own = free_name(docs, "_wanted")
    texts = docs.filter(F.col(f"`{key}`").isNotNull()).join(
        maybe_broadcast(wanted.withColumnRenamed("id", own)), F.col(f"`{key}`") == F.col(own), "left_semi"
    )
    sets = keep_table(full_sets(texts, text, key, size).dropDuplicates(["id"]))

    best = stars.groupBy("v").agg(F.max_by("u", F.struct("shared", -F.col("u"))).alias("u"))
    links = packed(_confirmed(best, sets, percent))
    labels = packed(components(links))

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components so far."""
        known = maybe_broadcast(labels)
        lu = known.select(F.col("id").alias("u"), F.col("component").alias("cu"))
        lv = known.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        return (
            pairs.join(lu, "u", "left")
            .join(lv, "v", "left")
            .filter("coalesce(cu, u) <> coalesce(cv, v)")
            .select("u", "v")
        )

    def grown(more: DataFrame) -> bool:
        nonlocal links, labels
        more = packed(more)
        if more.isEmpty():
            return False
        links = links.unionByName(more)
        known = labels.select(F.col("id").alias("u"), F.col("component").alias("v"))
        labels = packed(components(known.unionByName(more)))
        return True

    tried = best.select("u", "v")
    grown(_confirmed(apart(stars.select("u", "v").join(tried, ["u", "v"], "left_anti")), sets, percent))

    def still_mixed(groups: DataFrame, condition: str) -> DataFrame:
        """Rows of the groups that hold several components and fulfil ``condition``."""
        here = groups.join(maybe_broadcast(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = (
            here.groupBy("bucket")
            .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size"), F.max("few").alias("open"))
            .filter(f"least <> most AND {condition}")
            .select("bucket")
        )
        return here.join(mixed, "bucket", "left_semi").drop("component")

    unsure = still_mixed(crowded.select("bucket", "id", F.lit(True).alias("few")), "size > 2").select("id").distinct()
    open_sets = keep_table(sets.join(unsure, "id", "left_semi"))
    groups = still_mixed(packed(rare_groups(open_sets, percent)), "open")
    order = Window.partitionBy("bucket").orderBy(F.desc("few"), "id")
    ranked = packed(groups.withColumn("rank", F.row_number().over(order)))
    done = 0
    while True:
        # Pairs of a former centre have been checked.
        ranked = packed(still_mixed(ranked.filter(f"rank > {done}"), "open"))
        if ranked.isEmpty():
            break
        here = ranked.join(maybe_broadcast(labels), "id", "left").withColumn("component", F.coalesce("component", "id"))
        until = max(1, 8 * done)
        next_centres = here.filter(f"few AND rank <= {until}").select(
            "bucket", F.col("id").alias("u"), F.col("n").alias("m"), F.col("rest").alias("s"), F.col("rank").alias("r"), F.col("component").alias("c")
        )
        enough = f"{100 + percent} * least(rest, s) >= {percent} * (n + m)"
        pairs = (
            here.join(next_centres, "bucket")
            .filter(f"rank > r AND component <> c AND {enough}")
            .select("u", F.col("id").alias("v"))
            .distinct()
        )
        grown(_confirmed(pairs, sets, percent))
        done = until

    degree = (
        links.select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    )
    label = labels.select(F.col("id").alias("rep"), "component")
    placed = member.select("id", "rep").join(label, "rep", "left").join(degree, "rep", "left")
    return (
        found.select("id", F.col("n").alias("n_shingles"))
        .join(placed, "id", "left")
        .select(
            F.col("id").alias(key),
            "n_shingles",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "rep", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest key; of rows with
    the same key one stays. Rows with a null key all stay, and so do texts without words."""
    own = free_name(docs, "_gone")
    gone = F.col(own)
    found = keep(near_dedup(docs, text, key, size, percent).select(F.col(f"`{key}`").alias(own), "kept").filter(gone.isNotNull()))
    here = F.col(f"`{key}`") == gone
    out = docs.join(maybe_broadcast(keep(found.filter("NOT kept").select(own).distinct())), here, "left_anti")
    repeated = keep(found.filter("kept").groupBy(own).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(own))
    if repeated.isEmpty():
        return out
    once = out.join(repeated, here, "left_semi").dropDuplicates([key])
    return out.join(repeated, here, "left_anti").unionByName(once)
