"""Near-duplicate vectors: cross-polytope hashing, multiprobe buckets, verified pairs.

1. Equal vectors of one label are one class. A class is hashed in `tables` tables: each hash is the
   nearest signed axis after three rounds of random signs and a fast Hadamard transform; a table's
   bucket joins `hashes` of them. A class enters its own bucket and the `probes` next likely ones.
   choose_tables takes the hashes from the number of classes (so that chance meetings stay rare) and
   the tables from the wanted recall at the threshold, measured on drawn pairs of that angle.
2. Buckets with many classes (CORE) make a core: the members within half the threshold's angle of
   the bucket's mean direction. Any two of them link by the triangle inequality, so a group of near
   copies of any size is one unit and its pairs are never compared. All other classes are units
   of one.
3. Units of a bucket hang on its least unit at home there; connected components of these candidate
   pairs are clusters. A cluster is dealt into blocks of about BLOCK units and each pair of blocks is
   one task. Two units link fully or not at all when their centres' angle and radii prove it; two of
   one class each are compared by the cosine of their vectors; what is left open (a core that
   straddles the threshold) is compared class by class, in blocks too.
4. Tasks return numbers of links and one edge per unit to its local group, never lists of links.
   Components of these edges give component_id.

Vectors that are NULL, empty, zero, or hold NULL, NaN or infinity, and rows without a label, link
with nothing. Vectors of different lengths never link. Equal rows count one by one. A NULL vec_id
links like any other, and component_id is the least id that is not NULL (NULL where there is none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.ann import usable
from shelfwise.llm.common import bounded_batches, mix64, small
from shelfwise.llm.graph import components
from shelfwise.sources.scratch import stage

SIMILARITY = 0.93
RECALL = 0.9995
PROBES = 3
CHOICES = 4  # nearest axes of a hash that probes may take
DRAWN = 2000  # pairs on which a setting's recall is measured
# Chance meetings of a class at most, if buckets were even. They are not: a few axes of two turns lie
# close, which makes about five times as many, measured on vectors without structure.
CHANCE = 0.1
CORE, CORE_PASSES = 64, 3
BLOCK = 512
CENTRE_BYTES = 64 << 20
MARGIN = 1e-7  # radians by which a proof by angles must hold
SEED = 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows (length a power of two), in steps of radix 64."""
    rows, width = x.shape
    done = 1
    while done < width:
        radix = min(64, width // done)
        step = np.ones((1, 1), x.dtype)
        while len(step) < radix:
            step = np.block([[step, step], [step, -step]])
        if done == 1:
            x = (x.reshape(-1, radix) @ step).reshape(rows, width)
        else:
            x = np.matmul(step, x.reshape(rows, width // (done * radix), radix, done)).reshape(rows, width)
        done *= radix
    return x


def _width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def bucket_codes(units: np.ndarray, hashes: int, tables: int, probes: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers of unit vectors, the own bucket first."""
    rows, dim = units.shape
    width = _width(dim)
    padded = np.zeros((rows, width), np.float32)
    padded[:, :dim] = units
    choices = min(CHOICES, width)
    ways = np.stack(np.meshgrid(*[np.arange(choices)] * min(hashes, 4), indexing="ij"), -1).reshape(-1, min(hashes, 4))
    ways = np.pad(ways, ((0, 0), (0, hashes - ways.shape[1])))  # later hashes keep their nearest axis
    out = np.empty((rows, tables, 1 + probes), np.uint64)
    for table in range(tables):
        axes, lost = [], []
        for k in range(hashes):
            signs = np.random.default_rng([SEED, table, k, width]).choice(np.float32([-1, 1]), (3, width))
            turned = padded
            for sign in signs:
                turned = hadamard(turned * sign)
            turned = turned / np.float32(width**1.5)
            far = np.abs(turned)
            top = np.argpartition(-far, choices - 1, axis=1)[:, :choices]
            size = np.take_along_axis(far, top, 1)
            order = np.argsort(-size, axis=1, kind="stable")
            top, size = np.take_along_axis(top, order, 1), np.take_along_axis(size, order, 1)
            axes.append(top * 2 + (np.take_along_axis(turned, top, 1) < 0))
            lost.append((size[:, :1] - size) ** 2)
        cost = sum(gap[:, ways[:, k]] for k, gap in enumerate(lost))
        likely = np.argsort(cost, axis=1, kind="stable")[:, : 1 + probes]
        key = np.full(likely.shape, table, np.uint64)
        for k in range(hashes):
            part = np.take_along_axis(axes[k], ways[likely, k], 1).astype(np.uint64)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1))
        out[:, table, : likely.shape[1]] = key
        out[:, table, likely.shape[1] :] = key[:, :1]
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def choose_tables(rows: int, dim: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Hashes of a table and tables, for that many classes of one label."""
    draw = np.random.default_rng(SEED)
    one = _unit(draw.standard_normal((DRAWN, dim)))
    side = draw.standard_normal((DRAWN, dim))
    side -= (one * side).sum(axis=1, keepdims=True) * one
    lengths = np.linalg.norm(side, axis=1, keepdims=True)
    two = similarity * one + math.sqrt(max(0.0, 1 - similarity**2)) * side / np.where(lengths > 0, lengths, 1)
    for hashes in range(1, 9):
        a, b = (bucket_codes(_unit(x), hashes, 4, PROBES) for x in (one, two))
        met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).mean()
        met = min(max(met, 0.5 / DRAWN), 1 - 1e-4)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))
        if rows * tables * (1 + 2 * PROBES) <= CHANCE * (2.0 * _width(dim)) ** hashes:
            break
    return hashes, tables


def _array(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _sketch(settings: dict[int, tuple[int, int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                for first in range(0, len(part), 2048):
                    own = part.iloc[first : first + 2048]
                    codes = bucket_codes(_unit(_array(own["vector"])), *settings[int(dim)], PROBES)
                    mark = own["label_key"].to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(int(dim))
                    codes = mix64(codes ^ mix64(mark)[:, None, None])
                    rows, tables, each = codes.shape
                    yield pd.DataFrame(
                        {
                            "bucket": codes.reshape(-1).view(np.int64),
                            "cls": np.repeat(own["cls"].to_numpy(), tables * each),
                            "nth": np.tile(np.repeat(np.arange(tables, dtype=np.int32), each), rows),
                            "home": np.tile(np.arange(each) == 0, rows * tables),
                        }
                    )

    return run


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for bucket, part in frame.groupby("bucket"):
            yield pd.DataFrame({"bucket": [bucket], "total": [_unit(_array(part["vector"])).sum(axis=0)]})


def _centre(frame: pd.DataFrame) -> pd.DataFrame:
    total = _array(frame["total"]).sum(axis=0)
    size = np.linalg.norm(total)
    return pd.DataFrame({"bucket": frame["bucket"].iloc[:1], "centre": [total / size if size > 0 else total]})


def _angles(similarity: float):
    half = math.acos(similarity) / 2 - MARGIN

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.groupby("dim"):
                cosine = np.einsum("ij,ij->i", _unit(_array(part["vector"])), _array(part["centre"]))
                off = np.arccos(np.clip(cosine, -1, 1)) + MARGIN
                yield part.assign(off=off)[["cls", "bucket", "copies", "off"]][off <= half]

    return run


def cores(classes: DataFrame, sketches: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame] | None:
    """(cls, unit) of the classes in cores, and per core: unit, centre, radius, copies, members."""
    members = every_centre = None
    for nth in range(CORE_PASSES):
        homes = sketches.filter(F.col("home") & (F.col("nth") == nth)).select("bucket", "cls")
        if members is not None:
            homes = homes.join(members.select("cls"), "cls", "left_anti")
        full = stage(homes.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CORE).select("bucket"), "full")
        many = full.count()
        if not many:
            continue
        inside = stage(homes.join(small(full, many), "bucket").join(classes.select("cls", "dim", "copies", "vector"), "cls"), "inside")
        sums = inside.select("bucket", "vector").mapInPandas(_sums, "bucket long, total array<double>")
        centres = stage(sums.groupBy("bucket").applyInPandas(_centre, "bucket long, centre array<double>"), "centres")
        longest = inside.agg(F.max("dim")).first()[0]
        sent = F.broadcast(centres) if many * longest * 8 <= CENTRE_BYTES else centres
        near = inside.join(sent, "bucket").mapInPandas(_angles(similarity), "cls long, bucket long, copies long, off double")
        near = stage(near.withColumn("nth", F.lit(nth)), "near")
        centres = centres.withColumn("nth", F.lit(nth))
        members = near if members is None else members.unionByName(near)
        every_centre = centres if every_centre is None else every_centre.unionByName(centres)
    if members is None:
        return None
    keys = ["nth", "bucket"]
    found = members.groupBy(*keys).agg(
        F.min("cls").alias("unit"), F.max("off").alias("radius"), F.sum("copies").alias("copies"),
        F.count(F.lit(1)).alias("members"),
    )
    found = stage(found.join(every_centre, keys), "cores")
    names = stage(found.select(*keys, "unit"), "core-names")
    inside = members.select("cls", *keys).join(small(names, names.count()), keys).select("cls", "unit")
    return stage(inside, "core-members"), found.select("unit", "centre", "radius", "copies", "members")


def candidate_edges(sketches: DataFrame, inside: DataFrame | None) -> DataFrame:
    """Units of one bucket hang on the least unit that is at home there."""
    met = sketches.select("bucket", "cls", "home")
    if inside is not None:
        met = met.join(small(inside, inside.count()), "cls", "left").withColumn("unit", F.coalesce("unit", "cls"))
    else:
        met = met.withColumn("unit", F.col("cls"))
    met = stage(met.groupBy("bucket", "unit").agg(F.max("home").alias("home")), "buckets")
    # buckets of one unit, by far the most, end here
    hubs = met.groupBy("bucket").agg(
        F.min(F.when(F.col("home"), F.col("unit"))).alias("hub"), F.min("unit").alias("least"), F.max("unit").alias("most")
    )
    hubs = stage(hubs.filter("hub IS NOT NULL AND least < most").select("bucket", "hub"), "hubs")
    return met.join(small(hubs, hubs.count()), "bucket").filter("unit <> hub").select(F.col("unit").alias("a"), F.col("hub").alias("b"))


def _hubs(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, each row's least reachable row."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify_units(similarity: float):
    reach = math.acos(similarity)

    def pairs(own: pd.DataFrame) -> pd.DataFrame:
        own = own.drop_duplicates("unit").sort_values("unit", ignore_index=True)
        centre, radius = _unit(_array(own["centre"])), own["radius"].to_numpy()
        cosine = centre @ centre.T
        single = radius == 0
        linked = cosine >= similarity
        wanted = np.ones(linked.shape, bool)
        if own["lo"].iat[0] != own["hi"].iat[0]:  # pairs inside a block belong to its own task
            block = own["block"].to_numpy()
            wanted = block[:, None] != block[None, :]
        np.fill_diagonal(wanted, False)
        open_pairs = np.zeros((0, 2), np.int64)
        if not single.all():
            angle = np.arccos(np.clip(cosine, -1, 1))
            around = radius[:, None] + radius[None, :] + MARGIN
            exact = single[:, None] & single[None, :]
            unsure = ~exact & wanted & (angle + around > reach) & (angle - around <= reach)
            linked = np.where(exact, linked, angle + around <= reach)
            open_pairs = np.argwhere(np.triu(unsure))
        linked &= wanted
        unit = own["unit"].to_numpy()
        made = pd.DataFrame({"unit": unit, "hub": unit[_hubs(linked)], "docs": linked @ own["copies"].to_numpy(), "other": None})
        # the core of a pair, or the first of two, owns the comparison
        first, second = open_pairs[:, 0], open_pairs[:, 1]
        first, second = np.where(single[first], second, first), np.where(single[first], first, second)
        more = pd.DataFrame({"unit": unit[first], "hub": unit[first], "docs": 0, "other": unit[second]})
        return pd.concat([made.astype({"other": "Int64"}), more.astype({"other": "Int64"})])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pairs(own) for _, own in frame.groupby(["root", "label_key", "dim"])])

    return run


def _verify_members(similarity: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["cls", "inner"]).sort_values(["inner", "cls"], ignore_index=True)
        inner = frame["inner"].to_numpy()
        unit, copies, cls = _unit(_array(frame["vector"])), frame["copies"].to_numpy(), frame["cls"].to_numpy()
        linked = (unit @ unit.T >= similarity) & (inner[:, None] != inner[None, :])
        return pd.DataFrame({"cls": cls, "hub": cls[_hubs(linked)], "docs": linked @ copies})

    return run


def _open_members(checked: DataFrame, classes: DataFrame, inside: DataFrame, similarity: float) -> DataFrame:
    """cls, hub, docs for the classes of pairs of units that angles leave open."""
    asked = stage(checked.filter("other IS NOT NULL").select(F.col("unit").alias("owner"), "other"), "open")
    vectors = classes.select("cls", "copies", "vector")
    own = inside.join(asked.select(F.col("owner").alias("unit")).distinct(), "unit").select(F.col("unit").alias("owner"), "cls")
    # the other side: a core's members, or a class of its own
    theirs = (
        asked.join(inside.select(F.col("unit").alias("other"), "cls"), "other", "left")
        .select("owner", F.coalesce("cls", "other").alias("cls"))
    )
    both = own.withColumn("inner", F.lit(True)).unionByName(theirs.withColumn("inner", F.lit(False)))
    both = stage(both, "open-members")
    parts = lambda keep: F.ceil(F.sum(F.when(keep, 1).otherwise(0)) / F.lit(BLOCK)).cast("int")
    sizes = both.groupBy("owner").agg(parts(F.col("inner")).alias("rows"), parts(~F.col("inner")).alias("columns"))
    dealt = both.join(small(sizes, sizes.count()), "owner").join(vectors, "cls")
    spot = lambda n: F.pmod(F.xxhash64("cls", F.lit(11)), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.withColumn("i", F.explode(F.when(F.col("inner"), F.array(spot("rows"))).otherwise(all_of("rows"))))
    dealt = dealt.withColumn("j", F.explode(F.when(F.col("inner"), all_of("columns")).otherwise(F.array(spot("columns")))))
    made = dealt.select("owner", "i", "j", "inner", "cls", "copies", "vector").groupBy("owner", "i", "j")
    return stage(made.applyInPandas(_verify_members(similarity), "cls long, hub long, docs long"), "open-checked")


def near_duplicates(rows: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for rows of (vec_id, vector, label)."""
    if not 0 < similarity < 1:
        raise ValueError("similarity lies between 0 and 1")
    good = F.col("label").isNotNull() & usable(F.col("vector"))
    plain = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(good, F.col("label").cast("string")).alias("label"),
        F.when(good, F.transform("vector", lambda x: x.cast("double") + 0.0)).alias("vector"),
    )
    bounded_batches(rows.sparkSession)
    plain = stage(plain, "vector-rows")
    classes = (
        plain.filter("label IS NOT NULL")
        .groupBy("label", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
        .select(
            "*", F.size("vector").alias("dim"), F.xxhash64("label").alias("label_key"), F.monotonically_increasing_id().alias("cls")
        )
    )
    classes = stage(classes, "vector-classes")  # the numbers stay as written
    largest = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("dim").agg(F.max("n").alias("n"))
    settings = {r.dim: choose_tables(r.n, r.dim, similarity, recall) for r in largest.collect()}
    sketches = classes.select("cls", "label_key", "dim", "vector").mapInPandas(
        _sketch(settings), "bucket long, cls long, nth int, home boolean"
    )
    sketches = stage(sketches, "vector-buckets")
    found = cores(classes, sketches, similarity)
    inside, core = found or (None, None)
    checked = stage(_checked(classes, core, inside, components(candidate_edges(sketches, inside)), similarity), "vector-checked")
    edges = checked.filter("other IS NULL AND unit <> hub").select(F.col("unit").alias("a"), F.col("hub").alias("b"))
    links = checked.groupBy("unit").agg(F.sum("docs").alias("docs"))
    info = classes.withColumn("unit", F.col("cls"))
    if inside is not None:
        opened = _open_members(checked, classes, inside, similarity)
        edges = edges.unionByName(inside.filter("cls <> unit").select(F.col("cls").alias("a"), F.col("unit").alias("b")))
        edges = edges.unionByName(opened.filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))
        more = opened.groupBy("cls").agg(F.sum("docs").alias("more"))
        info = (
            classes.join(inside, "cls", "left")
            .join(core.select("unit", F.col("copies").alias("core_copies")), "unit", "left")
            .join(more, "cls", "left")
            .withColumn("unit", F.coalesce("unit", "cls"))
        )
    else:
        info = info.withColumn("core_copies", F.lit(None).cast("long")).withColumn("more", F.lit(0).cast("long"))
    info = (
        info.join(links, "unit", "left")
        .join(components(edges).withColumnRenamed("a", "cls"), "cls", "left")
        .select(
            "label", "vector", "least", F.coalesce("root", "cls").alias("root"),
            (
                F.coalesce("core_copies", "copies") - 1 + F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            ).alias("n_links"),
        )
    )
    info = stage(info, "vector-links")
    heads = stage(info.groupBy("root").agg(F.min("least").alias("component_id")), "vector-heads")
    # most classes are components of their own: only the others need the join
    named = info.join(heads, "root").select("label", "vector", "n_links", "component_id")
    known = F.col("n_links").isNotNull()
    return plain.join(named, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(known, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        F.col("vec_id").eqNullSafe(F.when(known, F.col("component_id")).otherwise(F.col("vec_id"))).alias("kept"),
    )


def _checked(classes: DataFrame, core: DataFrame | None, inside: DataFrame | None, roots: DataFrame, similarity: float) -> DataFrame:
    """unit, hub, docs per unit and pair of blocks; with `other` set, a pair that is left open."""
    clustered = roots.unionByName(roots.select(F.col("root").alias("a"), "root").distinct()).withColumnRenamed("a", "unit")
    clustered = stage(clustered, "vector-clusters")
    sizes = clustered.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("parts"))
    clustered = clustered.join(sizes, "root")
    keys = classes.select(F.col("cls").alias("unit"), "label_key", "dim", "vector", "copies")
    units = clustered.join(keys, "unit")
    if core is not None:
        whole = core.select("unit", "centre", "radius", F.col("copies").alias("core_copies"))
        units = units.join(whole, "unit", "left")
    else:
        units = units.withColumn("centre", F.lit(None).cast("array<double>")).withColumn("radius", F.lit(None).cast("double"))
        units = units.withColumn("core_copies", F.lit(None).cast("long"))
    units = units.select(
        "unit", "root", "parts", "label_key", "dim",
        F.coalesce("core_copies", "copies").alias("copies"),
        F.coalesce("radius", F.lit(0.0)).alias("radius"),
        F.coalesce("centre", "vector").alias("centre"),
        F.pmod(F.xxhash64("unit", F.lit(7)), F.col("parts")).cast("int").alias("block"),
    ).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # clusters of one block share tasks, about eight blocks to a task
    tasks = max(1, -(-clustered.count() // (8 * BLOCK)))
    dealt = units.select(
        "unit", "root", "label_key", "dim", "copies", "radius", "block", "centre",
        F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        (F.col("parts") > 1).alias("large"),
        F.when(F.col("parts") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root", F.lit(3)), F.lit(tasks))).alias("task"),
    )
    made = dealt.groupBy("large", "task", "lo", "hi").applyInPandas(_verify_units(similarity), "unit long, hub long, docs long, other long")
    return made
