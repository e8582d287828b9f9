"""Linking postings to physical units.

A posting and a unit score 40 for the same address, 30 for the same unit name, 20
for the same grid cell and 10 for close bedrooms and bathrooms; 60 links them.
Every accepted pair therefore agrees on two of {address, unit name, cell}, and the
score is fixed by the finest agreement plus closeness:

    agreement                    score   score with close rooms
    address + unit + cell           90      100
    address + unit                  70       80
    address + cell                  60       70
    unit + cell                      -       60

Each entry is a *rung*. Postings and units meet on rung keys by equi-join, and the
unit side is first reduced to its best entry per rung (and per distinct room counts
where closeness matters), so no pair of a crowded building is ever produced.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import ROOM_TOLERANCE, cell_index, rooms_close
from ..functions.text import blank_to_null, normalize_address, stable_id
from ..session import stage
from .ranking import sorted_position

# Weights, acceptance threshold, score of the posting that founds a unit.
ADDRESS_POINTS, UNIT_POINTS, CELL_POINTS, ROOM_POINTS = 40, 30, 20, 10
THRESHOLD = 60
FOUNDER_SCORE = 100

IDENTITY = ("addr", "unit_key", "cell_lat", "cell_lng", "bedrooms", "bathrooms")
_ALL_RUNGS = (("addr", "unit", "cell"), ("addr", "unit"), ("addr", "cell"), ("unit", "cell"))
_POINTS = {"addr": ADDRESS_POINTS, "unit": UNIT_POINTS, "cell": CELL_POINTS}


def _identity(address: Column, unit: Column, lat: Column, lng: Column) -> dict[str, Column]:
    located = lat.isNotNull() & lng.isNotNull()
    return {
        "addr": blank_to_null(address),
        "unit_key": blank_to_null(F.lower(unit)),
        "cell_lat": F.when(located, cell_index(lat)),
        "cell_lng": F.when(located, cell_index(lng)),
    }


def posting_identity(listings: DataFrame, strict: bool = True) -> DataFrame:
    """Add the comparable address, unit name and cell of postings; null means unknown."""
    address = normalize_address(F.col("address"), strict)
    return listings.withColumns(
        _identity(address, F.col("unit"), F.col("lat"), F.col("lng"))
    )


def unit_identity(units: DataFrame) -> DataFrame:
    return units.withColumns(
        _identity(F.col("canonical_address"), F.col("canonical_unit"), F.col("lat"), F.col("lng"))
    )


def match_score(a: str, b: str) -> Column:
    """Score of two identities under the column prefixes ``a`` and ``b``."""

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}{name}")

    def points(hit: Column, value: int) -> Column:
        return F.when(hit, F.lit(value)).otherwise(F.lit(0))

    same_cell = (col(a, "cell_lat") == col(b, "cell_lat")) & (col(a, "cell_lng") == col(b, "cell_lng"))
    close = rooms_close(
        col(a, "bedrooms"), col(b, "bedrooms"), col(a, "bathrooms"), col(b, "bathrooms")
    )
    return (
        points(col(a, "addr") == col(b, "addr"), ADDRESS_POINTS)
        + points(col(a, "unit_key") == col(b, "unit_key"), UNIT_POINTS)
        + points(same_cell, CELL_POINTS)
        + points(close, ROOM_POINTS)
    )


_RUNG_PARTS = {"addr": "addr", "unit": "unit_key", "cell": "concat(string(cell_lat), ',', string(cell_lng))"}
_RUNG_KNOWN = {"addr": "addr IS NOT NULL", "unit": "unit_key IS NOT NULL", "cell": "cell_lat IS NOT NULL"}


def _rung_array(build: bool, kinds, plain_only_accepting: bool) -> Column:
    """Rung keys of a row: ``key``, ``score``, and whether room counts must be close.

    Null entries are rungs the row is not on. Close rungs carry the whole-number bedroom
    bin in the key; the build side enters the neighbouring bins too, so a difference of
    0.5 always meets.
    """
    entries = []
    for kind in kinds:
        base = sum(_POINTS[k] for k in kind)
        name = "+".join(kind)
        known = " AND ".join(_RUNG_KNOWN[k] for k in kind)
        parts = ", ".join(_RUNG_PARTS[k] for k in kind)

        def entry(condition: str, label: str, score: int, close: bool) -> str:
            return (
                f"CASE WHEN {condition} THEN named_struct('key', concat_ws('\\u0001', {label}, {parts}), "
                f"'score', {score}, 'close', {str(close).lower()}) END"
            )

        if base >= THRESHOLD:
            entries.append(entry(known, f"'{name}'", base, False))
        if base < THRESHOLD or not plain_only_accepting:
            for shift in (-1, 0, 1) if build else (0,):
                bin_label = f"concat('{name}@', string(floor(bedrooms) + {shift}))"
                entries.append(entry(f"{known} AND bedrooms IS NOT NULL", bin_label, base + ROOM_POINTS, True))
    return F.expr(f"array({', '.join(entries)})")


def _with_rungs(df: DataFrame, keep: list[str], build: bool, neighbours_only: bool) -> DataFrame:
    kinds = _ALL_RUNGS[1:] if neighbours_only else _ALL_RUNGS
    return df.select(
        *keep, "bedrooms", "bathrooms",
        F.explode(_rung_array(build, kinds, neighbours_only)).alias("rung"),
    ).filter(F.col("rung").isNotNull()).select(*keep, "bedrooms", "bathrooms", "rung.*")


def _meet(probe: DataFrame, build: DataFrame, keep: list[str], payload: str, neighbours_only: bool) -> DataFrame:
    """Join probe rows with the first build entry (by ``payload``) of each rung."""
    best = (
        _with_rungs(build, [payload], True, neighbours_only)
        .withColumns(
            {
                "b_beds": F.when(F.col("close"), F.col("bedrooms")),
                "b_baths": F.when(F.col("close"), F.col("bathrooms")),
            }
        )
        .groupBy("key", "b_beds", "b_baths")
        .agg(F.min(payload).alias(payload))
    )
    probes = _with_rungs(probe, keep, False, neighbours_only)
    close = rooms_close(
        F.col("bedrooms"), F.col("b_beds"), F.col("bathrooms"), F.col("b_baths")
    )
    return probes.join(best, "key").filter(~F.col("close") | close)


def best_match(probe: DataFrame, units: DataFrame, probe_id: str, unit_order: str) -> DataFrame:
    """Best accepted unit per probe row: highest score, then first by ``unit_order``.

    ``unit_order`` is a struct column of ``units`` that orders and identifies them.
    """
    # Of units with equal fields only the first can win; this also shrinks what enters the rungs.
    firsts = units.groupBy(*IDENTITY).agg(F.min(unit_order).alias(unit_order))
    met = _meet(probe, firsts, [probe_id], unit_order, neighbours_only=False)
    rank = F.struct((-F.col("score")).alias("neg"), F.col(unit_order))
    return met.groupBy(probe_id).agg(F.min(rank).alias("best")).select(
        probe_id, (-F.col("best.neg")).alias("score"), F.col(f"best.{unit_order}").alias(unit_order)
    )


def score_histogram(probe: DataFrame, units: DataFrame, probe_id: str) -> DataFrame:
    """Number of accepted units per probe row and score, counted without forming pairs.

    A unit on a fine rung is also on the coarser ones; the counts per rung are taken
    apart by inclusion and exclusion.
    """
    counts = (
        _with_rungs(units.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("same")), ["same"], True, False)
        .withColumns(
            {
                "b_beds": F.when(F.col("close"), F.col("bedrooms")),
                "b_baths": F.when(F.col("close"), F.col("bathrooms")),
            }
        )
        .groupBy("key", "b_beds", "b_baths")
        .agg(F.sum("same").alias("n"))
    )
    close = rooms_close(F.col("bedrooms"), F.col("b_beds"), F.col("bathrooms"), F.col("b_baths"))
    met = (
        _with_rungs(probe, [probe_id], False, False)
        .join(counts, "key")
        .filter(~F.col("close") | close)
    )

    # Score and closeness name the rung: no two rungs share both.
    def total(score: int, near: bool) -> Column:
        hit = (F.col("score") == score) & (F.col("close") == F.lit(near))
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))

    plain = {"aug": 90, "au": 70, "ag": 60}
    near = {"aug": 100, "au": 80, "ag": 70, "ug": 60}
    sums = met.groupBy(probe_id).agg(
        *[total(score, False).alias(name) for name, score in plain.items()],
        *[total(score, True).alias(f"{name}_near") for name, score in near.items()],
    )
    # Units of exactly one kind of agreement: those on a rung less those also on a finer one.
    aug, au, ag = [F.col(c) for c in plain]
    aug_near, au_near, ag_near, ug_near = [F.col(f"{c}_near") for c in near]
    return sums.select(
        probe_id,
        aug_near.alias("n100"),
        (aug - aug_near).alias("n90"),
        (au_near - aug_near).alias("n80"),
        ((au - au_near) - (aug - aug_near) + (ag_near - aug_near)).alias("n70"),
        ((ag - ag_near) - (aug - aug_near) + (ug_near - aug_near)).alias("n60"),
    )


def candidate_counts(probe: DataFrame, units: DataFrame, probe_id: str) -> DataFrame:
    """Units each posting has to be compared with: same address, or near its cell.

    Near means within one cell width of the cell's centre, on both axes. Counted per
    address, per cell and per both (to take the overlap off), never as pairs. A unit
    enters the at most nine cells around it, whatever the number of postings there.
    """
    width = 0.001
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = (
        units.filter(F.col("cell_lat").isNotNull())
        .select("addr", "lat", "lng", "cell_lat", "cell_lng", F.explode(steps).alias("dy"))
        .select("*", F.explode(steps).alias("dx"))
        .select(
            "addr", "lat", "lng",
            (F.col("cell_lat") + F.col("dy")).alias("cell_lat"),
            (F.col("cell_lng") + F.col("dx")).alias("cell_lng"),
        )
        .filter(
            F.col("lat").between(F.col("cell_lat") / 1000 - width, F.col("cell_lat") / 1000 + width)
            & F.col("lng").between(F.col("cell_lng") / 1000 - width, F.col("cell_lng") / 1000 + width)
        )
    )
    by_addr = units.filter(F.col("addr").isNotNull()).groupBy("addr").agg(F.count(F.lit(1)).alias("n_addr"))
    both = (
        near.filter(F.col("addr").isNotNull())
        .groupBy("addr", "cell_lat", "cell_lng")
        .agg(F.count(F.lit(1)).alias("n_both"))
    )
    by_cell = near.groupBy("cell_lat", "cell_lng").agg(F.count(F.lit(1)).alias("n_near"))
    return (
        probe.select(probe_id, "addr", "cell_lat", "cell_lng")
        .join(by_addr, "addr", "left")
        .join(by_cell, ["cell_lat", "cell_lng"], "left")
        .join(both, ["addr", "cell_lat", "cell_lng"], "left")
        .select(
            probe_id,
            F.coalesce("n_addr", F.lit(0)).alias("same_address"),
            F.coalesce("n_near", F.lit(0)).alias("near_cell"),
            (
                F.coalesce("n_addr", F.lit(0)) + F.coalesce("n_near", F.lit(0)) - F.coalesce("n_both", F.lit(0))
            ).alias("candidates"),
        )
    )


@dataclass
class LinkResult:
    """Outcome of one run: one link per posting, the founded units' postings marked."""

    links: DataFrame  # listing_id, unit_id, match_score, founds_unit
    rounds: int


def founded_unit_id(listing_id: Column) -> Column:
    return stable_id(F.lit("unit"), listing_id)


def refounded_unit_id(listing_id: Column, arrival: Column) -> Column:
    """Unit that a posting founds which has one already: another one per arrival."""
    return stable_id(F.lit("unit"), listing_id, F.date_format(arrival, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def newest_first() -> list[Column]:
    """Order in which a full run visits postings: newest first, then by id."""
    return [F.col("last_seen_at").desc(), F.col("listing_id")]


def oldest_first() -> list[Column]:
    """Order of arrival, for micro-batches."""
    return [F.col("last_seen_at"), F.col("listing_id")]


def link_postings(
    listings: DataFrame,
    units: DataFrame,
    order: list[Column] | None = None,
    linked: DataFrame | None = None,
    strict: bool = True,
    refound: bool = False,
) -> LinkResult:
    """Attach each posting to a unit, or let it found one, as if visited one by one.

    Visiting order decides: a posting attaches to the best unit known by then, and
    founds a unit when none reaches the threshold. Founders are the
    lexicographically first independent set of the "would link" graph, found in
    rounds: every undecided posting with no earlier undecided neighbour founds a
    unit, its neighbours are then taken, and the rest goes on.

    Postings that agree on every compared field form one node. Nodes sharing an
    address+unit or address+cell rung are all neighbours of each other, so a round
    only needs the first node of each rung, not the pairs; its cost is linear.

    ``linked`` (unit_id, listing_id) marks postings that already have a unit: they
    found none, and without a match they keep that unit. With ``refound`` they found
    a second unit instead, one per arrival (``last_seen_at``), as the first pass does
    for postings it does not know.
    """
    rows = posting_identity(listings, strict)
    if linked is not None:
        kept = linked.groupBy("listing_id").agg(F.min("unit_id").alias("kept_unit"))
        rows = rows.join(kept, "listing_id", "left")
    else:
        rows = rows.withColumn("kept_unit", F.lit(None).cast("string"))
    # Written before the sort: range partitioning reads its input twice, and the address
    # rule should not run twice over the source.
    rows = stage(
        rows.select(
            "listing_id", "last_seen_at", F.col("kept_unit").isNotNull().alias("had_unit"),
            (F.lit(None).cast("string") if refound else F.col("kept_unit")).alias("kept_unit"),
            *IDENTITY,
            F.concat_ws(
                "\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in IDENTITY]
            ).alias("vector"),
        ),
        "identity",
    )
    rows = sorted_position(rows, order or newest_first(), "ord")
    # Made where it is needed: an id per row is most of a row.
    own_unit = F.when(F.col("had_unit"), refounded_unit_id(F.col("listing_id"), F.col("last_seen_at"))).otherwise(
        founded_unit_id(F.col("listing_id"))
    )

    nodes = stage(
        rows.groupBy("vector", *IDENTITY)
        .agg(
            F.min(F.when(F.col("kept_unit").isNull(), F.col("ord"))).alias("ord"),
            F.min("ord").alias("node"),
        )
        .withColumn("self_score", match_score("", "")),
        "nodes",
    )
    known = unit_identity(units).select(
        F.struct("created_at", "unit_id").alias("unit_ord"), *IDENTITY
    )
    linkable = nodes.filter(F.col("self_score") >= THRESHOLD)
    existing = stage(best_match(linkable, known, "node", "unit_ord"), "existing")

    founders, rounds = _found_units(
        linkable.filter(F.col("ord").isNotNull())
        .join(existing.select("node"), "node", "left_anti")
        .select("node", "ord", *IDENTITY)
    )
    founders = stage(founders, "founders")

    # Founders a node can reach: one per address rung, and on the unit+cell rung a
    # handful that are mutually not close, so the list per node is short by geometry.
    reach = (
        _meet(linkable, founders, ["node"], "ord", neighbours_only=False)
        .groupBy("node", "ord")
        .agg(F.max("score").alias("score"))
        .join(rows.select("ord", "listing_id", "last_seen_at", "had_unit"), "ord")
        .withColumn("founded_unit", own_unit)
        .groupBy("node")
        .agg(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ord", "founded_unit")).alias("founders"))
    )
    options = (
        nodes.select("vector", "node", "self_score")
        .join(existing, "node", "left")
        .join(reach, "node", "left")
        .join(founders.select("node", F.col("ord").alias("founder_ord")), "node", "left")
        .drop("node")
    )
    joined = rows.select("listing_id", "last_seen_at", "had_unit", "ord", "vector", "kept_unit").join(options, "vector")
    near = F.array_min(F.filter("founders", lambda f: f["ord"] < F.col("ord")))
    alone = F.col("kept_unit").isNull() & (F.col("self_score") < THRESHOLD)
    founds = F.coalesce(F.col("ord") == F.col("founder_ord"), F.lit(False)) | alone
    # Same score: the unit that existed before the run wins.
    by_founder = F.col("near").isNotNull() & F.coalesce(-F.col("near.neg") > F.col("score"), F.lit(True))
    links = (
        joined.withColumn("near", near)
        .withColumn("founds_unit", founds)
        .select(
            "listing_id",
            F.when(founds, own_unit)
            .when(by_founder, F.col("near.founded_unit"))
            .otherwise(F.col("unit_ord.unit_id"))
            .alias("unit_id"),
            F.when(founds, F.lit(FOUNDER_SCORE))
            .when(by_founder, -F.col("near.neg"))
            .otherwise(F.col("score"))
            .cast("double")
            .alias("match_score"),
            "founds_unit",
        )
        # A linked posting without a match keeps the unit it has: nothing to write.
        .filter(F.col("match_score").isNotNull())
    )
    return LinkResult(stage(links, "links"), rounds)


#: Undecided nodes that one narrow step may hold (their compared fields, about 200 bytes each).
SOLVED_AT_ONCE = 100_000
#: Nodes of small components that are visited together on average.
SOLVED_TOGETHER = 10_000


def _found_units(undecided: DataFrame) -> tuple[DataFrame, int]:
    """Nodes that found a unit (node, ord, identity), and the rounds that took.

    The first round decides most nodes. What it leaves is solved in visiting order by one narrow step if
    it is small. Else it is split into components of nodes that share rungs, and the small components are
    solved side by side, however long the chains in them are; only components too large for a task go on in rounds.
    """
    undecided = stage(undecided, "undecided")
    founders = undecided.limit(0)
    rounds, left = 0, undecided.count()
    while left:
        rounds += 1
        if left <= SOLVED_AT_ONCE:
            return founders.unionByName(_solve(undecided.withColumn("part", F.lit(0).cast("bigint")))), rounds
        if rounds == 2:
            parts = stage(undecided.join(_components(undecided), "node"), "parts")
            sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
            giants = stage(sizes.where(F.col("size") > SOLVED_AT_ONCE).select("part"), "giants")
            # a giant has more than SOLVED_AT_ONCE nodes, so giants are few
            small = parts.join(F.broadcast(giants), "part", "left_anti")
            # no two components accept each other's nodes, so many are visited in one go, not a group each
            bins = F.lit(left // SOLVED_TOGETHER + 1)
            small = small.withColumn("part", F.pmod(F.xxhash64("part"), bins))
            founders = founders.unionByName(stage(_solve(small), "solved"))
            undecided = stage(parts.join(F.broadcast(giants), "part", "left_semi").drop("part"), "undecided")
            left = undecided.count()
            continue
        first = (
            _meet(undecided.drop("ord"), undecided, ["node"], "ord", neighbours_only=True)
            .groupBy("node")
            .agg(F.min("ord").alias("first"))
        )
        marked = stage(
            undecided.join(first, "node").withColumn("founds", F.col("first") == F.col("ord")).drop("first"),
            "marked",
        )
        chosen = marked.filter("founds").drop("founds")
        rest = marked.filter("not founds").drop("founds")
        taken = _meet(rest.drop("ord"), chosen, ["node"], "ord", neighbours_only=True).select("node")
        undecided = stage(rest.join(taken, "node", "left_anti"), "undecided")
        left = undecided.count()
        founders = founders.unionByName(chosen)
    return founders, rounds


def _solve(nodes: DataFrame) -> DataFrame:
    """Founders among the nodes of each ``part``, visited one by one; a part fits a task."""
    columns = [c for c in nodes.columns if c != "part"]
    schema = ", ".join(f"{c} {t}" for c, t in nodes.select(*columns).dtypes)
    return nodes.groupBy("part").applyInPandas(lambda part: first_founders(part)[columns], schema)


def first_founders(nodes: pd.DataFrame) -> pd.DataFrame:
    """The nodes that found a unit when visited by ``ord``: those no earlier founder accepts.

    Sharing address and unit, or address and cell, is enough to be accepted; unit and cell also need close rooms.
    """
    nodes = nodes.sort_values("ord")
    taken: set[tuple] = set()
    rooms: dict[tuple, list[tuple]] = {}
    chosen = []

    def known(x) -> bool:
        return x is not None and x == x

    for at, (addr, unit, lat, lng, beds, baths) in enumerate(nodes[list(IDENTITY)].itertuples(index=False, name=None)):
        cell = (lat, lng) if known(lat) else None
        rungs = [("unit", addr, unit)] if known(addr) and known(unit) else []
        if known(addr) and cell:
            rungs.append(("cell", addr, cell))
        near = rooms.setdefault((unit, cell), []) if known(unit) and cell and known(beds) else None
        if any(r in taken for r in rungs):
            continue
        if near is not None and any(
            abs(b - beds) <= ROOM_TOLERANCE and not (known(c) and known(baths) and abs(c - baths) > ROOM_TOLERANCE) for b, c in near
        ):
            continue
        taken.update(rungs)
        if near is not None:
            near.append((beds, baths))
        chosen.append(at)
    return nodes.iloc[chosen]


def _components(nodes: DataFrame) -> DataFrame:
    """``node, part``: nodes connected by shared rung keys have the smallest node of them as part.

    A rung with close rooms connects all of its bedroom bin and the bins beside it, so a part may be larger than
    need be, but no two nodes that accept each other are parted. Labels sink along rungs and then jump to their label's
    label, so a chain of n nodes takes about log n steps.
    """
    member = stage(_with_rungs(nodes, ["node"], True, True).select("node", "key").distinct(), "members")
    labels = stage(nodes.select("node", F.col("node").alias("part")), "labels")
    while True:
        lowest = member.join(labels, "node").groupBy("key").agg(F.min("part").alias("low"))
        lower = member.join(lowest, "key").groupBy("node").agg(F.min("low").alias("low"))
        sunk = stage(
            labels.join(lower, "node", "left").select("node", F.col("part").alias("was"), F.least("part", "low").alias("part")), "sunk"
        )
        up = sunk.select(F.col("node").alias("part"), F.col("part").alias("above"))
        labels = stage(sunk.join(up, "part").select("node", "was", F.col("above").alias("part")), "labels")
        moved = labels.where(F.col("was") != F.col("part")).limit(1).count()
        labels = labels.select("node", "part")
        if not moved:
            return labels
