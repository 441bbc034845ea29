"""A sample that meets target shares per category (problem 4).

Observed joint categories are counted once; raking gives each joint cell its target count, made whole without changing
any category's sum as far as that goes, and repaired by exchanges where it does not; the ratio of target to observed
count is a cell's acceptance probability. Rows are accepted independently by a hash of their id, slightly more than
needed, and the counts are then corrected exactly: a histogram of the hashes tells below which value a cell is full, and
only rows of the bucket at the border are ranked. Buckets go on beyond the acceptance probability, so that a cell that
chance left short is topped up. Categories that cannot reach their target are reported; where the joint targets cannot be
met together, ``least_gap`` proves it (a bound from linear programming duality).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Joint cells are kept on the driver; so many are an error in the targets, not data.
MAX_CELLS = 100_000
#: Buckets of the accepted hashes, and of those up to each doubling beyond.
BUCKETS, BEYOND = 1024, 16
#: Rounds of raking, of exchanges without progress, and of the bound's ascent.
ROUNDS, TRIES, ASCENT = 200, 400, 2000


def norm_label(c: Column) -> Column:
    """Trimmed, lower case, space, hyphen and underscore alike."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s-]", "_")


def usable_rows(data: DataFrame, key: str, labels: dict[str, Column]) -> DataFrame:
    """Distinct (key, label...) with normalised labels; of a redelivered key any delivery (they are equal) counts once."""
    x = data.where(F.col(key).isNotNull()).select(key, *[norm_label(c).alias(d) for d, c in labels.items()])
    return x.groupBy(key).agg(*[F.max(d).alias(d) for d in labels])


def requirements(rows: DataFrame, targets: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, category, required, available, deficit) per target row.

    required: the greater of min_rows and round(target_share x sample_rows); deficit: what is missing of it. Rows of
    ``targets`` that name another dimension are unavailable; a null label counts for no category.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions]))
    counts = rows.select(pairs.alias("x")).where("x.label is not null").groupBy(F.col("x.dimension").alias("d"), F.col("x.label").alias("l")).agg(F.count("*").alias("available"))
    need = F.greatest(F.coalesce(F.col("min_rows"), F.lit(0)), F.coalesce(F.round(F.col("target_share") * F.col("sample_rows")).cast("long"), F.lit(0)))
    t = targets.select("dimension", "category", need.alias("required"))
    got = t.join(counts, (F.col("dimension") == F.col("d")) & (norm_label(F.col("category")) == F.col("l")), "left")
    return got.select(
        "dimension", "category", "required", F.coalesce("available", F.lit(0)).alias("available"), F.greatest(F.lit(0), F.col("required") - F.coalesce("available", F.lit(0))).alias("deficit")
    )


class Margins:
    """Sums of whole counts per category of every dimension that has targets, against what is wanted."""

    def __init__(self, cells: np.ndarray, index: list[np.ndarray], wanted: list[np.ndarray]):
        pairs = [(at, w) for at, w in zip(index, wanted) if len(w)]  # a dimension without targets constrains nothing
        self.cells, self.dims = cells, len(pairs)
        start = np.cumsum([0, *[len(w) for _, w in pairs]])
        self.size = int(start[-1])
        self.wanted = np.concatenate([w for _, w in pairs]) if pairs else np.zeros(0, np.int64)
        # Row of each cell's category in every dimension; the last row, never wanted, is for those without one.
        self.at = np.array([np.where(at >= 0, at + a, self.size) for (at, _), a in zip(pairs, start)], np.int64).reshape(self.dims, len(cells))

    def sums(self, k: np.ndarray) -> np.ndarray:
        return sum((np.bincount(at, k, self.size + 1) for at in self.at), np.zeros(self.size + 1))[: self.size]

    def gap(self, k: np.ndarray) -> np.ndarray:
        """What each category is short of (negative: over), and 0 for the row without category."""
        return np.append(self.wanted - np.rint(self.sums(k)).astype(np.int64), 0)

    def rake(self) -> np.ndarray:
        """Proportional counts, at most ``cells``, by iterative fitting."""
        t = self.cells.astype(float)
        w = np.append(self.wanted, 0).astype(float)
        for _ in range(ROUNDS):
            for at in self.at:
                s = np.bincount(at, t, self.size + 1)
                f = np.divide(w, s, out=np.ones_like(s), where=s > 0)
                f[self.size] = 1.0
                t = t * f[at]
            t = np.minimum(t, self.cells)
        return t

    def rounded(self, t: np.ndarray) -> np.ndarray:
        """Whole counts with the sums of ``t`` but for at most as many cells as there are categories.

        Any more cells with fractions than categories depend linearly on each other: moving them along that dependence
        changes no sum and makes one of them whole.
        """
        t = t.copy()
        open_ = list(np.flatnonzero(np.abs(t - np.rint(t)) > 1e-9))
        block: list[int] = []
        while True:
            while open_ and len(block) <= self.size:
                block.append(int(open_.pop()))
            if len(block) <= self.size:
                break
            m = np.zeros((self.size + 1, len(block)))
            for at in self.at:
                m[at[block], np.arange(len(block))] += 1
            v = np.linalg.svd(m[: self.size])[2][-1]
            x = t[block]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(v > 1e-12, (np.ceil(x) - x) / v, np.where(v < -1e-12, (np.floor(x) - x) / v, np.inf))
            t[block] = x + v * room.min()
            whole = np.abs(t[block] - np.rint(t[block])) <= 1e-7
            whole[int(room.argmin())] = True
            for i, done in zip(list(block), whole):
                if done:
                    t[i] = np.rint(t[i])
            block = [i for i, done in zip(block, whole) if not done]
        return np.minimum(np.rint(t).astype(np.int64), self.cells)

    def repaired(self, k: np.ndarray) -> np.ndarray:
        """``k`` with rows added, removed and exchanged between cells while that brings the sums nearer to ``wanted``.

        Where no single step helps, steps that change nothing in sum are tried in a fixed random order, the cells just
        used last.
        """
        k = k.copy()
        rng = np.random.default_rng(0)
        g = self.gap(k)
        best, best_gap, idle = k.copy(), int(np.abs(g).sum()), 0
        used = np.zeros(len(k), np.int64)
        for turn in range(1, TRIES * 50):
            if best_gap == 0 or idle > TRIES:
                break
            # Change of the summed gaps if one row is added to (taken from) each cell.
            more = np.where(g > 0, -1, 1)
            less = np.where(g < 0, -1, 1)
            more[self.size] = less[self.size] = 0
            add = np.where(k < self.cells, more[self.at].sum(0), 99)
            take = np.where(k > 0, less[self.at].sum(0), 99)
            top = lambda x: np.flatnonzero(x <= np.partition(x, min(40, len(x) - 1))[min(40, len(x) - 1)])
            ups, downs = (rng.permutation(top(x + np.minimum(turn - used < 5, 1) * (idle > 0)))[:200] for x in (add, take))
            options = [(int(add[u]), u, -1) for u in ups[add[ups] <= 0][:1]] + [(int(take[d]), -1, d) for d in downs[take[downs] <= 0][:1]]
            # A pair's change is the sum of both but in categories they share.
            shared = self.at[:, ups][:, :, None] == self.at[:, downs][:, None, :]
            both = (more[self.at[:, ups]][:, :, None] + less[self.at[:, downs]][:, None, :]) * ~shared
            change = both.sum(0) + np.where(add[ups] >= 99, 99, 0)[:, None] + np.where(take[downs] >= 99, 99, 0) + (ups[:, None] == downs) * 99
            change = change + rng.random(change.shape) * 0.5 + ((used[ups][:, None] > turn - 5) | (used[downs] > turn - 5)) * 0.4
            u, d = np.unravel_index(int(change.argmin()), change.shape)
            options.append((int(np.floor(change[u, d])), ups[u], downs[d]))
            value, u, d = min(options, key=lambda o: o[0])
            if value > 0:
                idle += 1
                continue
            step = 1
            for c, sign in ((u, 1), (d, -1)):
                if c >= 0:
                    k[c] += sign * step
                    used[c] = turn
            g = self.gap(k)
            now = int(np.abs(g).sum())
            idle = 0 if now < best_gap else idle + 1
            if now < best_gap:
                best, best_gap = k.copy(), now
        return best

    def least_gap(self) -> int:
        """A proven lower bound of the summed gaps of any sample: for weights y within -1..1 of the categories no counts
        k bring the gaps below ``y * wanted - sum over the cells of cells * max(0, y of its categories)``."""
        if not self.size:
            return 0
        y = np.zeros(self.size + 1)
        best, top = 0.0, y

        def value(y: np.ndarray) -> float:
            return float(y[: self.size] @ self.wanted - (self.cells * np.maximum(y[self.at].sum(0), 0)).sum())

        k = np.minimum(np.rint(self.rake()).astype(np.int64), self.cells)
        y[: self.size] = np.sign(self.gap(k))[: self.size]
        scale = 1.0 / max(1.0, float(self.wanted.max(initial=1)))
        for i in range(ASCENT):
            price = y[self.at].sum(0)
            now = float(y[: self.size] @ self.wanted - (self.cells * np.maximum(price, 0)).sum())
            if now > best:
                best, top = now, y
            g = np.append(self.wanted - self.sums(np.where(price > 0, self.cells, 0)), 0)
            y = np.clip(y + scale * g / (1 + i) ** 0.5, -1, 1)
            y[self.size] = 0
        # The best weights are mostly whole or halves: one category after the other.
        y = np.rint(top * 2) / 2
        for _ in range(20):
            before = best
            for j in range(self.size):
                for v in (-1.0, -0.5, 0.0, 0.5, 1.0):
                    z = y.copy()
                    z[j] = v
                    if (now := value(z)) > max(best, value(y)):
                        best, y = now, z
            if best <= before:
                break
        return int(np.ceil(best - 1e-6))


def allot(cells: np.ndarray, index: list[np.ndarray], wanted: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Whole counts per cell, at most ``cells``, whose sums per category come as near as possible to ``wanted``, and how
    far from it any counts must stay at least (0 where the sums are met)."""
    m = Margins(cells, index, wanted)
    if not m.dims or not len(cells):
        return np.zeros_like(cells), int(m.wanted.sum())
    k = m.repaired(m.rounded(m.rake()))
    return k, m.least_gap() if np.abs(m.gap(k)).sum() else 0


def plan(rows: DataFrame, targets: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(label..., observed, wanted, least_gap) per joint cell; a label outside the targets is null."""
    req = [r.asDict() for r in requirements(rows, targets, dimensions).withColumn("l", norm_label(F.col("category"))).orderBy("dimension", "category").collect()]
    need: dict[str, dict[str, int]] = {d: {} for d in dimensions}  # spellings of one category: the greatest target holds
    for r in req:
        if r["dimension"] in need and r["l"] is not None:
            have = need[r["dimension"]]
            have[r["l"]] = max(have.get(r["l"], 0), min(r["required"], r["available"]))
    known = {d: list(need[d]) for d in dimensions}
    named = rows.select(*[F.when(F.col(d).isin(known[d]), F.col(d)).alias(d) for d in dimensions])
    counted = named.groupBy(*dimensions).agg(F.count("*").alias("observed")).limit(MAX_CELLS + 1).collect()
    if len(counted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} joint cells")
    counted.sort(key=lambda r: tuple(r[d] or "" for d in dimensions))
    cells = np.array([r["observed"] for r in counted], np.int64)
    index = [np.array([known[d].index(r[d]) if r[d] is not None else -1 for r in counted], np.int64) for d in dimensions]
    wanted = [np.array(list(need[d].values()), np.int64) for d in dimensions]
    k, least = allot(cells, index, wanted)
    out = [(*[r[d] for d in dimensions], int(r["observed"]), int(x), least) for r, x in zip(counted, k)]
    return rows.sparkSession.createDataFrame(out, ", ".join(f"{d} string" for d in dimensions) + ", observed long, wanted long, least_gap long")


def draw(rows: DataFrame, cells: DataFrame, key: str, dimensions: Sequence[str], seed: int = 0) -> DataFrame:
    """(key, label...) of the sample: of every cell exactly ``wanted`` rows, chosen by a hash of the key."""
    known = [[r[0] for r in cells.select(d).where(F.col(d).isNotNull()).distinct().collect()] for d in dimensions]
    x = rows.select(key, *dimensions, *[F.when(F.col(d).isin(k), F.col(d)).alias(f"c_{d}") for d, k in zip(dimensions, known)])
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) / F.lit(float(1 << 53))
    c = cells.where("wanted > 0").select(*[F.col(d).alias(f"w_{d}") for d in dimensions], "observed", "wanted")
    # A surplus of four standard deviations; 1 takes every row.
    p = F.least(F.lit(1.0), (F.col("wanted") + 4 * F.sqrt("wanted") + 10) / F.col("observed"))
    same = None
    for d in dimensions:
        e = F.col(f"c_{d}").eqNullSafe(F.col(f"w_{d}"))
        same = e if same is None else same & e
    asked = x.withColumn("u", u).join(F.broadcast(c), same).withColumn("p", p)  # at most MAX_CELLS rows
    ratio = F.col("u") / F.col("p")
    late = F.lit(BUCKETS) + F.floor(F.log2(F.greatest(ratio, F.lit(1.0))) * BEYOND)
    asked = asked.withColumn("bucket", F.when(ratio < 1, F.floor(ratio * BUCKETS)).otherwise(late).cast("long"))
    cell = [f"c_{d}" for d in dimensions]
    hist = asked.groupBy(*cell, "wanted", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The bucket in which a cell fills up, and the room left there: one row per cell.
    border = hist.withColumn("room", F.col("wanted") - before).where("room > 0 and room <= n").select(*[F.col(c).alias(f"h_{c}") for c in cell], F.col("bucket").alias("border"), "n", "room")
    on = None
    for c2 in cell:
        e = F.col(c2).eqNullSafe(F.col(f"h_{c2}"))
        on = e if on is None else on & e
    kept = asked.join(F.broadcast(border), on).where("bucket <= border")  # at most MAX_CELLS rows
    whole = kept.where("bucket < border or n = room").select(key, *dimensions)
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("u", key))
    last = kept.where("bucket = border and n > room").withColumn("rank", rank).where("rank <= room").select(key, *dimensions)
    return whole.unionByName(last)


def short_categories(rows: DataFrame, targets: DataFrame, key: str, dimensions: Sequence[str]) -> DataFrame:
    """``sample_report`` of the target rows that no sample can meet, each dimension by itself.

    A sample is drawn per dimension; a category is short where the sample holds all its usable rows and not enough.
    """
    found = []
    for d in dimensions:
        t = targets.where(F.col("dimension") == d)
        found.append(sample_report(requirements(rows, t, [d]), draw(rows, plan(rows, t, [d]), key, [d]), [d]))
    other = targets.where(~F.coalesce(F.col("dimension").isin(list(dimensions)), F.lit(False)))
    found.append(sample_report(requirements(rows, other, dimensions), rows.where("false"), dimensions))
    return reduce(DataFrame.unionByName, found).where("unmet > 0 and sampled = available")


def synthetic_labels() -> dict[str, Column]:
    return {d: F.col(f"metadata.{d}") for d in ("question_type", "difficulty", "target_pedagogical_state")}


def sample_report(req: DataFrame, sample: DataFrame, dimensions: Sequence[str], least_gap: int = 0) -> DataFrame:
    """``requirements`` with the rows that the sample holds per category and what it is short of (unmet). least_gap: by how
    many rows, in all categories together, every sample must miss what the categories by themselves could hold."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions]))
    got = sample.select(pairs.alias("x")).groupBy(F.col("x.dimension").alias("d"), F.col("x.label").alias("l")).agg(F.count("*").alias("sampled"))
    j = req.join(got, (F.col("dimension") == F.col("d")) & (norm_label(F.col("category")) == F.col("l")), "left")
    out = j.select("dimension", "category", "required", "available", F.coalesce("sampled", F.lit(0)).alias("sampled"), "deficit")
    return out.withColumn("unmet", F.greatest(F.lit(0), F.col("required") - F.col("sampled"))).withColumn("least_gap", F.lit(least_gap).cast("long"))
