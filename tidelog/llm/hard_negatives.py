"""Hard-negative mining over rotated one-bit codes: interval bounds from popcounts, integer scores for what they leave.

A vector of unit length is rotated (random signs and Hadamard transforms) and replaced by the signs of its components, one
bit each; the alignment of code and vector is stored. What the code leaves, the residual, is rotated and coded again,
LEVELS times; the length of each residual is stored. An anchor is rotated alike and its components rounded to PLANES bits, so
that its product with a code is a sum of popcounts. By Cauchy-Schwarz the product with the last residual is at most
its length times the length of the anchor's part at right angles to the code, so each level gives an interval that
surely holds the product. Rows whose interval can't reach what is sought are dropped level by level; those that
survive get their integer score. Nothing is estimated in the result.

Rows are cut into blocks, anchors into teams; a task holds one of each. First the best rows of an anchor's own label
are found (its positives), then for each positive the best rows of other labels whose score is in the window between
two shares of the positive's.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Vectors meet
only those of their length. Components are floored after scaling, scores are exact whole numbers of any size (given
as the nearest long, where they don't fit). Higher scores first, ties to the smaller id. Positives have another id than
their anchor. Repeated anchor rows that are alike in id, label and vector are answered once, others each; repeated
rows count each. Fewer positives or negatives than asked for are all returned; a negative positive's window is empty.
An empty table gives an empty result. Columns other than id, label and vector are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from tidelog.llm.common import stored
from tidelog.llm.topk import LONG, beyond, exact_matrix, whole

#: Rows in a block, anchors in a team.
BLOCK_ROWS, TEAM = 8192, 512
#: Codes per vector, and bits of an anchor's rounded components.
LEVELS, PLANES = 4, 8


def rotated(x: np.ndarray, level: int) -> np.ndarray:
    """Rows of a power of two of components, in the coordinates of a level."""
    n = x.shape[1]
    signs = np.random.default_rng((level, n)).choice([-1.0, 1.0], (2, n))
    for s in signs:
        x = x * s
        half = 1
        while half < n:  # Hadamard
            pairs = x.reshape(len(x), -1, 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), n)
            half *= 2
        x = x / np.sqrt(n)
    return x


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, padded to a power of two of 64 components at least; lengths) of whole-number rows."""
    x = x.astype(np.float64)
    most = np.abs(x).max(1, initial=0)
    safe = np.where(most > 0, most, 1)[:, None]
    rest = np.sqrt(((x / safe) ** 2).sum(1))
    unit = x / safe / np.where(rest > 0, rest, 1)[:, None]
    return np.pad(unit, ((0, 0), (0, max(64, 1 << (x.shape[1] - 1).bit_length()) - x.shape[1]))), most * rest


def packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=-1)).view(np.uint64)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per level and row: the code's bits, its alignment with what it codes, the length of what it leaves."""
    codes, aligned, left = [], [], []
    for level in range(LEVELS):
        unit = rotated(unit, level)
        scale = 1 / np.sqrt(unit.shape[1])
        codes.append(packed(unit >= 0).T)
        aligned.append(np.abs(unit).sum(1) * scale)
        unit = unit - aligned[-1][:, None] * np.where(unit >= 0, scale, -scale)
        left.append(np.sqrt((unit**2).sum(1)))
    return np.stack(codes), np.stack(aligned), np.stack(left)


class Asked:
    """Anchors (unit vectors) in the coordinates of each level, their components rounded to bit planes."""

    def __init__(self, units: np.ndarray) -> None:
        self.levels = []
        for level in range(LEVELS):
            units = rotated(units, level)
            low = units.min(1)
            step = np.maximum(units.max(1) - low, 1e-30) / ((1 << PLANES) - 1)
            rounded = np.rint((units - low[:, None]) / step[:, None]).astype(np.int64)
            planes = packed(np.stack([(rounded >> k) & 1 for k in range(PLANES)], 1).astype(bool))
            off = np.abs(units - (low[:, None] + step[:, None] * rounded)).sum(1)
            self.levels.append((planes, low, step, rounded.sum(1), off, (units**2).sum(1)))

    def bounds(self, a: int, level: int, codes: np.ndarray, aligned: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates of what the level's codes stand for, half widths of the interval with what they leave) of anchor
        ``a``; ``codes`` has a row per 64 components."""
        planes, low, step, total, off, length = (x[a] for x in self.levels[level])
        n = len(codes) * 64
        scale = 1 / np.sqrt(n)
        # with bits b: sum of (2 b - 1) q over the components, q = low + step * rounded
        met, ones = (np.zeros(codes.shape[1], np.int32) for _ in range(2))
        for w, word in enumerate(codes):
            ones += np.bitwise_count(word)
            for k, plane in enumerate(planes):
                met += np.bitwise_count(word & plane[w]).astype(np.int32) << k
        product = (scale * 2 * low) * ones + (scale * 2 * step) * met - scale * (low * n + step * total)
        nearest = np.maximum(np.abs(product) - scale * off, 0)
        return aligned * product, aligned * (scale * off) + left * np.sqrt(np.maximum(length - nearest**2, 0))


def surviving(asked: Asked, a: int, length: float, block: dict, rows: np.ndarray, windows: list[tuple[float, float]], k: int) -> np.ndarray:
    """Those of the ``rows`` of a block that may be among the ``k`` best of one of anchor ``a``'s score ``windows``."""
    codes, aligned, left, lengths = (block[c] for c in ("codes", "aligned", "left", "lengths"))
    size = lengths[rows] * length
    slack = 1e-9 * size + 1e-3
    middle = np.zeros(len(rows))
    widest = [(min(x for x, _ in windows), max(y for _, y in windows))]
    for level in range(LEVELS):
        if not len(rows):
            break
        estimate, width = asked.bounds(a, level, codes[level][:, rows], aligned[level][rows], left[level][rows])
        middle = middle + estimate
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = (middle - width) * size - slack, (middle + width) * size + slack
        keep = np.zeros(len(rows), bool)
        last = level == LEVELS - 1
        for least, most in windows if last else widest:
            floor = least
            if last or len(windows) == 1:  # k rows that are surely inside bound the others
                inside = low[(high <= most) & (low >= least)]
                floor = np.partition(inside, len(inside) - k)[len(inside) - k] if len(inside) >= k else least
            keep |= ~(high < floor) & ~(low > most)
        rows, middle, size, slack = rows[keep], middle[keep], size[keep], slack[keep]
    return rows


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to the smaller id."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.sort(scores)[-k])
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def inside(scores: np.ndarray, least: int, most: int) -> np.ndarray:
    """Places of the scores from ``least`` to ``most``."""
    if scores.dtype != object:  # such scores are below 2^63; what is beyond that bounds none
        least, most = (max(-LONG, min(LONG - 1, x)) for x in (least, most))
        if scores.dtype == np.float64:
            least, most = (max(-(1 << 53), min(1 << 53, x)) for x in (least, most))
    return np.flatnonzero((scores >= least) & (scores <= most))


def packs(rows: DataFrame, size: int, scale: int, code: bool, name: str) -> DataFrame:
    """One row per pack of about ``size`` ``rows``: ``d``, ``pack`` and ``labels``, ``ids``, ``x``, ``q`` of its rows, and
    ``sought``, where they have it; with their codes on demand."""
    n = max(1, -(-rows.count() // size))
    lists = {"labels": ("label", pa.list_(pa.string()))} | ({"sought": ("sought", pa.list_(pa.list_(pa.string())))} if "sought" in rows.columns else {})
    binaries = ["ids", "x", "q", *(["codes", "aligned", "left"] if code else [])]

    def build(part: pa.Table) -> pa.Table:
        x = np.asarray(part.column("v").combine_chunks().flatten()).reshape(part.num_rows, -1)
        parts = [np.asarray(part.column("id"), np.int64), x, np.asarray(part.column("q"), np.int64)]
        if code:
            parts += coded(directions(whole(x, scale))[0])
        columns = [part.column(c).slice(0, 1) for c in ("d", "pack")]
        columns += [pa.array([part.column(c).to_pylist()], kind) for c, kind in lists.values()]
        columns += [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]
        return pa.table(columns, names=["d", "pack", *lists, *binaries])

    dealt = rows.withColumn("d", F.size("v")).withColumn("pack", F.pmod(F.xxhash64("id", "q"), F.lit(n)).cast("int"))
    kinds = {"labels": "array<string>", "sought": "array<array<string>>"}
    return stored(dealt.groupBy("d", "pack").applyInArrow(build, "d int, pack int" + "".join(f", {c} {kinds[c]}" for c in lists) + "".join(f", {c} binary" for c in binaries)), name)


def opened(row: dict, d: int, scale: int) -> dict:
    """A block or team of vectors of ``d`` components again as arrays."""
    out = {"ids": np.frombuffer(row["ids"], np.int64), "q": np.frombuffer(row["q"], np.int64), "labels": np.array(row["labels"]), "sought": row.get("sought")}
    out["x"] = whole(np.frombuffer(row["x"]).reshape(-1, d), scale)
    out["unit"], out["lengths"] = directions(out["x"])
    if "codes" in row:  # a block
        n = len(out["ids"])
        out["codes"] = np.frombuffer(row["codes"], np.uint64).reshape(LEVELS, -1, n)
        out["aligned"], out["left"] = (np.frombuffer(row[c]).reshape(LEVELS, n) for c in ("aligned", "left"))
    return out


FOUND = pa.schema([("q", pa.int64()), ("k", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string()), ("exact", pa.string())])


def searched(blocks: DataFrame, teams: DataFrame, scale: int, search) -> DataFrame:
    """What ``search(block, team)`` yields - (q, k, id, score) - of every block and team of vectors of one length."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            block, team = (opened(t.slice(0, 1).to_pylist()[0], left.column("d")[0].as_py(), scale) for t in (left, right))
            block["x"], team["x"] = exact_matrix(block["x"], team["x"])
            names = np.unique(np.concatenate([block["labels"], team["labels"]]))
            for side in (block, team):
                side["label"] = np.searchsorted(names, side["labels"])
            found = [(q, k, i, max(-LONG, min(LONG - 1, s)), beyond(s), str(s)) for q, k, i, s in search(block, team)]
        columns = zip(*found, strict=True) if found else [[] for _ in FOUND]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)

    # every block with every team of its length: numbers of packs only, then an equi-join
    numbers = blocks.select("d", F.col("pack").alias("block")).join(teams.select("d", F.col("pack").alias("team")), "d")
    met = numbers.join(blocks.withColumnRenamed("pack", "block"), ["d", "block"])
    by = ["d", "block", "team"]
    sides = numbers.join(teams.withColumnRenamed("pack", "team"), ["d", "team"])
    sides = sides.select(*[F.col(c).alias(f"_{c}") for c in by], *teams.drop("d", "pack").columns)
    return met.groupBy(*by).cogroup(sides.groupBy(*[f"_{c}" for c in by])).applyInArrow(run, "q long, k int, id long, score long, beyond string, exact string")


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("beyond").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def labelled(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``id``, ``v`` (doubles) and ``label`` (as text) of the rows that take part."""
    whole_vector = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(whole_vector, F.lit(False)))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))


def as_float(n: int) -> float:
    return float(n) if abs(n) < 10**300 else np.inf if n > 0 else -np.inf


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``window`` has the least and the largest share of the positive's score, in hundredths, of a negative's.
    """
    least, most = window
    rows = labelled(vectors, key, vector, label).withColumn("q", F.monotonically_increasing_id())
    asked = stored(labelled(anchors, key, vector, label).distinct().withColumn("q", F.monotonically_increasing_id()), "anchors")
    blocks = packs(rows, BLOCK_ROWS, scale, True, "blocks")

    def own_label(block: dict, team: dict):
        anchors = Asked(team["unit"])
        for a, q in enumerate(team["q"].tolist()):
            same = np.flatnonzero((block["label"] == team["label"][a]) & (block["ids"] != team["ids"][a]))
            if len(same) > positives:
                same = surviving(anchors, a, team["lengths"][a], block, same, [(-np.inf, np.inf)], positives)
            scores = block["x"][same] @ team["x"][a]
            for i in best_of(scores, block["ids"][same], positives):
                yield q, 0, int(block["ids"][same[i]]), int(scores[i])

    found = stored(ranked(searched(blocks, packs(asked, TEAM, scale, False, "teams"), scale, own_label), positives, "q"), "positives")
    # a few scores per anchor
    sought = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "exact"))).alias("s")).select("q", F.col("s.exact").alias("sought"))

    def other_labels(block: dict, team: dict):
        anchors = Asked(team["unit"])
        for a, q in enumerate(team["q"].tolist()):
            scores = [int(s) for s in team["sought"][a]]
            bounds = [(-(-least * s // 100), most * s // 100) for s in scores]
            open_to = [(as_float(x), as_float(y)) for x, y in bounds if x <= y]
            if not open_to:
                continue
            other = np.flatnonzero(block["label"] != team["label"][a])
            other = surviving(anchors, a, team["lengths"][a], block, other, open_to, negatives)
            met = block["x"][other] @ team["x"][a]
            for k, (x, y) in enumerate(bounds):
                fit = inside(met, x, y)
                for i in fit[best_of(met[fit], block["ids"][other[fit]], negatives)]:
                    yield q, k + 1, int(block["ids"][other[i]]), int(met[i])

    mined = ranked(searched(blocks, packs(asked.join(sought, "q"), TEAM, scale, False, "teams"), scale, other_labels), negatives, "q", "k")
    mined = mined.select("q", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = found.select("q", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(found, ["q", "k"]).join(asked.select("q", F.col("id").alias("anchor_id")), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
