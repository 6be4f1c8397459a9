"""Language by nearest centroid: cosine of TF-IDF n-gram vectors with several clustered centroids per language.

Features are byte n-grams of lower-cased words with their bounds, hashed to ``DIMS`` places. Document
frequencies are counted over all texts that may be learned from. Centroids are spherical k-means centres of
a sample of at most ``sample_rows`` texts per language, one task each; a language's sample is kept as sparse
vectors of bounded size, whatever the length of its texts. Each centroid has a radius, within which nearly
all texts of its cluster lie: a text outside the radius of its nearest centroid is rejected as unlike anything learned.

Texts are read twice, once to learn and once to predict; neither reading shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.shared import keep_table
from llm.words import slices

SIZES = (2, 3, 4)
BITS = 13
DIMS = 1 << BITS
#: Rows and bytes of texts whose counts are held at once.
ROWS, SLICE = 256, 1 << 20
SAMPLE_ROWS = 1000
#: More different languages than this are an error: their centroids are sent to all tasks.
MOST_LANGUAGES = 500
CENTROIDS = 4
ROUNDS = 12
#: A cluster with a smaller share of its language's sample is left out.
LEAST_SHARE = 0.05
#: Share of a cluster's texts that lie within its radius.
WITHIN = 0.99
UNKNOWN = "und"

_SPACE = 0x20
_NORMAL = np.full(256, _SPACE, np.uint8)
_NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_NORMAL[0x80:] = np.arange(0x80, 0x100)
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z, À-Þ in UTF-8), other ASCII as blanks, the remaining bytes as they are."""
    out = np.frombuffer(bytearray(data.tobytes().translate(_NORMAL.tobytes())), np.uint8)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[after]
    out[after[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 0x20
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Row and feature of every gram, as row * DIMS + place, for one size after the other."""
    # A blank before each row bounds its first word and the last one of the row before.
    letters = np.append(np.insert(_letters(data), offsets[:-1], _SPACE), np.uint8(_SPACE))
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32) * np.int32(DIMS), np.diff(offsets) + 1)
    inside = letters != _SPACE
    code = letters.astype(np.uint32)
    # Blanks on either side may be part of a gram, those between its ends not.
    whole = inside[1:] | inside[:-1]
    gram = code
    for size, factor in zip(SIZES, _FACTORS, strict=True):
        n = len(letters) - size + 1
        if n <= 0:
            break
        if size > 2:
            whole = whole[:n] & inside[size - 2 : size - 2 + n]
        # A gram is the one that is a letter shorter, and the next letter.
        gram = gram[:n] << np.uint32(8)
        gram |= code[size - 1 :]
        place = gram * factor
        place >>= np.uint32(32 - BITS)
        yield (row[:n] + place.view(np.int32))[whole]


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Occurrences of every feature, a line per row. Grams stay within a word and the blanks around it."""
    rows = len(offsets) - 1
    # All sizes are counted at once: the array of counts is far larger than the grams of a short text.
    found = np.concatenate([np.zeros(0, np.int32), *_grams(data, offsets)])
    return np.bincount(found, minlength=rows * DIMS).reshape(rows, DIMS)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a row has a letter of any script."""
    low = data | 0x20
    total = np.concatenate([[0], np.cumsum((low >= 0x61) & (low <= 0x7A))])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found).tolist():
        own = data[offsets[i] : offsets[i + 1]]
        if (own >= 0x80).any():
            found[i] = any(c.isalpha() for c in own.tobytes().decode(errors="ignore"))
    return found


def _counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, counts, bytes, offsets) of runs of at most ``ROWS`` rows.

    A text longer than ``SLICE`` is counted in parts that end at blanks; a longer word is a part of its own."""
    for first, last, data, offsets in slices(column, SLICE):
        if len(data) > SLICE:
            total, start = np.zeros((1, DIMS), np.int64), 0
            ends = np.flatnonzero(_NORMAL[data] == _SPACE)
            while start < len(data):
                at = int(np.searchsorted(ends, start + SLICE, "right")) - 1
                if at < 0 or ends[at] <= start:
                    at += 1
                end = int(ends[at]) + 1 if at < len(ends) else len(data)
                total += gram_counts(data[start:end], np.array([0, end - start]))
                start = end
            yield first, last, total, data, offsets
            continue
        for a in range(0, last - first, ROWS):
            b = min(a + ROWS, last - first)
            own, ends = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            yield first + a, first + b, gram_counts(own, ends), own, ends


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square roots of counts times inverse document frequencies, of length 1; no features give zeros."""
    out = np.sqrt(counts, dtype=np.float32) * weights
    length = np.sqrt(np.einsum("ij,ij->i", out, out))
    return out / np.where(length > 0, length, 1)[:, None]


def centroids(points: np.ndarray, most: int = CENTROIDS) -> list[tuple[np.ndarray, float]]:
    """Spherical k-means: (centre, radius) of each cluster that is not a mere handful."""
    random = np.random.default_rng(len(points))
    centres = points[random.integers(len(points))][None]
    while len(centres) < min(most, len(points)):
        far = np.maximum(0, 1 - (points @ centres.T).max(axis=1)) ** 2
        if not far.sum() > 0:
            break
        centres = np.vstack([centres, points[random.choice(len(points), p=far / far.sum())]])
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[nearest == c].sum(axis=0) for c in range(len(centres)) if (nearest == c).any()])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    closeness = points @ centres.T
    nearest = closeness.argmax(axis=1)
    sizes = np.bincount(nearest, minlength=len(centres))
    kept = np.flatnonzero(sizes >= min(LEAST_SHARE * len(points), sizes.max()))
    return [(centres[c], float(1 - np.quantile(closeness[nearest == c, c], 1 - WITHIN))) for c in kept]


def _learned_rows(learnable: DataFrame, sample_rows: int) -> tuple[DataFrame, int]:
    """(lang, turn, places, counts) of sampled texts and (place, n) document frequencies, in one table; and the
    number of texts learned from."""
    sizes = learnable.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).limit(MOST_LANGUAGES + 1).toArrow().to_pylist()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the column does not hold languages")
    total = sum(r["size"] for r in sizes)
    if not total:
        return None, 0
    # A little over the sample's share of each language; what is over goes by the turn.
    schema = "_lang string, _share double"
    shares = [(r["lang"], (sample_rows + 8 * sample_rows**0.5) / r["size"]) for r in sizes]
    share = F.broadcast(learnable.sparkSession.createDataFrame(shares, schema))
    turn = F.xxhash64("text", F.monotonically_increasing_id())
    rows = (
        learnable.withColumn("turn", turn)
        .join(share, F.col("lang") == F.col("_lang"))
        .select("lang", "turn", "text", (F.pmod("turn", F.lit(1 << 30)) < F.col("_share") * F.lit(1 << 30)).alias("picked"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "turn", "places", "counts", "place", "n"]
        texts_with = np.zeros(DIMS, np.int64)
        for batch in batches:
            picked = batch.column("picked").to_numpy(zero_copy_only=False)
            for first, last, counts, *_ in _counted(batch.column("text")):
                texts_with += np.count_nonzero(counts, axis=0)
                own = np.flatnonzero(picked[first:last])
                if len(own):
                    places = [np.flatnonzero(counts[i]) for i in own]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("lang").take(pa.array(first + own)),
                            batch.column("turn").take(pa.array(first + own)),
                            pa.array([p.astype(np.uint16).tobytes() for p in places], pa.binary()),
                            pa.array([counts[i][p].astype(np.uint32).tobytes() for i, p in zip(own, places, strict=True)], pa.binary()),
                            pa.nulls(len(own), pa.int32()),
                            pa.nulls(len(own), pa.int64()),
                        ],
                        names,
                    )
        used = np.flatnonzero(texts_with)
        empty = [pa.nulls(len(used), t) for t in (pa.string(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used.astype(np.int32)), pa.array(texts_with[used])], names)

    return keep_table(rows.mapInArrow(run, "lang string, turn bigint, places binary, counts binary, place int, n bigint")), total


def learn_languages(learnable: DataFrame, sample_rows: int = SAMPLE_ROWS, most: int = CENTROIDS) -> tuple:
    """(languages, centroids, radii, weights) from rows of (lang, text) without nulls; a row of ``centroids`` each."""
    kept, total = _learned_rows(learnable, sample_rows)
    if kept is None:
        return [], np.zeros((0, DIMS), np.float32), np.zeros(0), np.ones(DIMS, np.float32)
    found = kept.filter(F.col("place").isNotNull()).groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    texts_with = np.zeros(DIMS)
    texts_with[found.column("place").to_numpy()] = found.column("n").to_numpy()
    weights = (np.log((1 + total) / (1 + texts_with)) + 1).astype(np.float32)

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(sample), DIMS), np.float32)
        for i, (places, n) in enumerate(zip(sample["places"], sample["counts"], strict=True)):
            counts[i, np.frombuffer(places, np.uint16)] = np.frombuffer(n, np.uint32)
        made = centroids(vectors(counts, weights), most)
        return pd.DataFrame({"lang": sample["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c, _ in made], "radius": [r for _, r in made]})

    turns = Window.partitionBy("lang").orderBy("turn")
    sample = kept.filter(F.octet_length("places") > 0).withColumn("at", F.row_number().over(turns)).filter(F.col("at") <= sample_rows)
    made = sample.orderBy("turn").groupBy("lang").applyInPandas(fit, "lang string, centre binary, radius double")
    rows = made.orderBy("lang", "centre").toArrow().to_pylist()
    centres = [np.frombuffer(r["centre"], np.float32) for r in rows]
    return [r["lang"] for r in rows], np.array(centres, np.float32).reshape(-1, DIMS), np.array([r["radius"] for r in rows]), weights


def identify_languages(
    docs: DataFrame,
    learn_from: Column,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample_rows: int = SAMPLE_ROWS,
    most: int = CENTROIDS,
) -> DataFrame:
    """Per row of ``docs``: key, lang_pred, score (cosine with the nearest centroid, 0 to 1), rejected.

    Learned are the texts and languages of the rows where ``learn_from`` holds and neither is null; nothing else enters a
    prediction. lang_pred is the language of the nearest centroid (ties: the first language in order), also for
    rejected texts, which lie outside its radius. Null texts and texts without a letter are ``und`` with score 0, and rejected; so is
    everything if nothing was learned. An empty table gives no rows. Keys may be null or repeat; each row stands for itself. Other
    columns are ignored, whatever their names. More than ``MOST_LANGUAGES`` languages are an error.
    """
    own = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), learn_from.alias("learn"))
    learnable = own.filter(F.col("learn") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sent = docs.sparkSession.sparkContext.broadcast(learn_languages(learnable, sample_rows, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radii, weights = sent.value
        across = centres.T.copy()
        for batch in batches:
            for first, last, counts, data, offsets in _counted(batch.column("text")):
                letters = _has_letter(data, offsets)
                best, score = np.zeros(last - first, np.int64), np.zeros(last - first)
                rejected = np.ones(last - first, bool)
                if len(names):
                    closeness = vectors(counts, weights) @ across
                    best = closeness.argmax(axis=1)
                    near = closeness[np.arange(len(best)), best].astype(np.float64)
                    score = np.where(letters, np.clip(near, 0, 1), 0)
                    rejected = ~letters | (1 - near > radii[best])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(first, last - first),
                        pa.array([names[b] if ok and names else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], pa.string()),
                        pa.array(score),
                        pa.array(rejected),
                    ],
                    ["key", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return texts.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
