"""Matching two registries without a common key: sorted neighbourhood, weighted similarities, one-to-one assignment.

Every row of both registries is written under several composite sort keys. All keys are sorted in one pass; a row's
position in the sort gives its window, and windows meet in an equi-join on position blocks of exactly one window's
rows, so no block can grow however many rows share a value. Pairs that some window brings together are compared field
by field, and the accepted pairs are assigned one to one so that the total confidence is greatest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.components import component_roots
from gridloom.session import forget, materialise

WINDOW = 12
#: Weights of name, city and capacity; where a field is missing the others carry its weight. Checked on the 120
#: labelled pairs: a renamed plant keeps town and capacity, a sister plant only the name, a neighbour only the town.
WEIGHTS = (0.35, 0.45, 0.20)
ACCEPT = 0.63
#: Relative difference of two capacities at which they have nothing in common.
CAPACITY_SPAN = 0.30
SAME_TOWN = 0.80
#: Pairs of a component that are assigned in one task (about 100 bytes each); larger components go to the auction.
TASK_PAIRS = 20_000
#: Least raise of a price in the auction, and so what an assigned row of such a component may lack in confidence.
RAISE = 0.005

# Words of legal forms and trades that say nothing about the owner, with their short forms.
GENERIC = frozenset(
    "ethanol eth biofuels biofuel bio fuel fuels renewable renewables renew energy bioenergy cooperative coop op co company inc incorporated llc ltd limited lp llp"
    " partnership corp corporation biorefining biorefinery refining grain grains processing proc plant the of at and l c".split()
)
TOWN_WORDS = frozenset("city town township twp village of the rural n s e w north south east west near".split())
_TOKEN = re.compile(r"[^\W_]+")


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with neighbour swaps, or ``most`` + 1 if it is greater.

    The columns of the table are bit vectors of their vertical differences, as in published work, so a letter of ``b``
    costs a few operations on one whole number.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, diagonal, seen, score = full, 0, 0, 0, len(a)
    for i, y in enumerate(b):
        hit = where.get(y, 0)
        swap = ((~diagonal & hit) << 1) & seen
        diagonal = ((((hit & up) + up) ^ up) | hit | down | swap) & full
        more, less = (down | ~(diagonal | up)) & full, diagonal & up
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        if score - (len(b) - 1 - i) > most:
            return most + 1
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down, seen = (less | ~(diagonal | more)) & full, more & diagonal, hit
    return score


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """1 for equal texts, 0 from an edit distance of 40 % of the longer one on."""
    longer = max(len(a), len(b))
    if not longer:
        return 0.0
    most = int(0.4 * longer)
    return max(0.0, 1 - distance(a, b, most) / max(most + 1, 1))


def town_key(city: str | None) -> str:
    """Lower-case town without words such as City of, Twp or rural."""
    words = [w for w in _TOKEN.findall((city or "").lower()) if w not in TOWN_WORDS]
    return " ".join(words)


@lru_cache(maxsize=100_000)
def _generic(word: str) -> bool:
    """Whether a word is generic, also with one slip."""
    return word in GENERIC or len(word) >= 5 and any(abs(len(g) - len(word)) <= 1 and len(g) >= 5 and distance(g, word, 1) <= 1 for g in GENERIC)


def owner_words(name: str | None, town: str) -> list[str]:
    """Words of a name that are neither generic, also with one slip, nor its town."""
    out = []
    for w in _TOKEN.findall((name or "").lower().replace("l.l.c", "llc")):
        if len(w) == 1 or _generic(w):
            continue
        if town and likeness(w, town.replace(" ", "")) >= 0.6:
            continue
        out.append(w)
    return out


def words_likeness(a: list[str], b: list[str]) -> float:
    """Share of letters of both word lists that find a like word in the other in any order, or the likeness of the
    lists as written together, whichever is more: a slip may join two words."""
    if not a or not b:
        return 0.0
    total = sum(map(len, a)) + sum(map(len, b))
    both = ((a, b), (b, a))
    apart = sum(len(w) * max(likeness(w, v) for v in other) for one, other in both for w in one) / total
    return max(apart, likeness("".join(a), "".join(b))) if len(a) != len(b) else apart


def compare(name_a: str | None, town_a: str, cap_a: float | None, name_b: str | None, town_b: str, cap_b: float | None) -> tuple[float, float, float, float]:
    """(confidence, name, town, capacity) of two rows; a missing field is NaN."""
    return compare_words(owner_words(name_a, town_a), town_a, cap_a, owner_words(name_b, town_b), town_b, cap_b)


def compare_words(words_a: list[str], town_a: str, cap_a: float | None, words_b: list[str], town_b: str, cap_b: float | None) -> tuple[float, float, float, float]:
    """``compare`` with the owner words of both rows at hand."""
    if town_a and town_b:
        town = likeness(town_a, town_b)
    else:
        # A town that only one row states may stand in the other's name.
        known, words = (town_a, words_b) if town_a else (town_b, words_a)
        inside = [w for w in words if known and likeness(w, known.replace(" ", "")) >= 0.6]
        town = 1.0 if inside else float("nan")
        if inside and town_a:
            words_b = [w for w in words_b if w not in inside]
        elif inside:
            words_a = [w for w in words_a if w not in inside]
    name = words_likeness(words_a, words_b)
    if cap_a is None or cap_b is None or not cap_a > 0 or not cap_b > 0:
        capacity = float("nan")
    else:
        capacity = max(0.0, 1 - abs(cap_a - cap_b) / max(cap_a, cap_b) / CAPACITY_SPAN)
    total = weight = 0.0
    for value, w in zip((name, town, capacity), WEIGHTS, strict=True):
        if value == value:
            total += value * w
            weight += w
    confidence = total / weight
    if town != town:
        confidence = min(confidence, 0.95) if name >= 0.8 and capacity == capacity else 0.0
    elif town < SAME_TOWN / 2:
        confidence = 0.0
    return confidence, name, town, capacity


def sort_keys(state: str, words: list[str], town: str, capacity: float | None) -> list[str]:
    """The composite keys of a row, each led by the state."""
    owner = " ".join(sorted(words))
    longest = max([*words, town.replace(" ", "")], key=len, default="")
    mw = f"{capacity:09.2f}" if capacity is not None and capacity >= 0 else "~"
    return [f"{state}|{k}" for k in (f"{town}|{mw}|{owner}", f"{owner}|{town}|{mw}", f"{town[::-1]}|{owner}", f"{longest}|{mw}", f"{owner[::-1]}|{mw}|{town}")]


_ROW = "side int, id long, state string, words string, town string, capacity double"


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of both registries with their owner words and town key, one row for each sort key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for side, key, state, name, city, cap in pdf.itertuples(index=False, name=None):
                cap = None if cap is None or cap != cap else float(cap)
                name = name if isinstance(name, str) else None
                town = town_key(city if isinstance(city, str) else None)
                state = state if isinstance(state, str) else ""
                words = owner_words(name, town)
                out += [(i, k, side, key, state, " ".join(words), town, cap) for i, k in enumerate(sort_keys(state, words, town, cap))]
            yield pd.DataFrame(out, columns=["key_no", "key", "side", "id", "state", "words", "town", "capacity"])

    return rows.mapInPandas(run, f"key_no int, key string, {_ROW}")


def neighbour_pairs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (left, right: struct) at most ``window`` places apart under some key, the lesser (side, id) on the left.

    The order is total, so ties fall the same way each time. Positions run over the whole sort: a window may reach
    over a partition's end, and over the end of a key, which brings only pairs that compare badly.
    """
    spark = rows.sparkSession
    # Written first, since finding the ranges reads the keys once more.
    ordered = materialise(_keyed(rows), "keys").repartitionByRange("key_no", "key", "side", "id").sortWithinPartitions("key_no", "key", "side", "id")
    placed = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumns({"part": F.shiftright("_id", 33), "at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    # One row for each partition of the sort.
    sizes = sorted(placed.groupBy("part").agg(F.max("at").alias("last")).collect())
    starts, total = [], 0
    for part, last in sizes:
        starts.append((part, total))
        total += last + 1
    offsets = spark.createDataFrame(starts, "part long, start long")
    row = F.struct("side", "id", "state", "words", "town", "capacity")
    placed = placed.join(F.broadcast(offsets), "part").select((F.col("start") + F.col("at")).alias("pos"), row.alias("row"))
    block = F.floor(F.col("pos") / window)
    one = placed.select(block.alias("block"), F.col("pos").alias("p"), F.col("row").alias("one"))
    two = placed.select(F.explode(F.array(block, block - 1)).alias("block"), F.col("pos").alias("q"), F.col("row").alias("two"))
    pairs = one.join(two, "block").where((F.col("q") > F.col("p")) & (F.col("q") - F.col("p") <= window))
    first = F.struct("one.side", "one.id") <= F.struct("two.side", "two.id")
    pairs = pairs.select(F.when(first, F.col("one")).otherwise(F.col("two")).alias("left"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("right"))
    return pairs.where((F.col("left.state") == F.col("right.state")) & (F.col("left.side") == 0) & ~((F.col("right.side") == 0) & (F.col("left.id") == F.col("right.id"))))


def _may_share_town(a: Column, b: Column) -> Column:
    """Cheap test before the comparison: a missing town, or towns that ``likeness`` may find alike enough.

    Only pairs of confidence 0 fail it: a town counts up to ``forgiven`` edits, each of which changes the length by one
    at most and is one or, for a swap, two edits without swaps.
    """
    most = F.floor(F.greatest(F.length(a), F.length(b)) * F.lit(0.4))
    forgiven = F.floor((most + 1) * 3 / 5)  # 1 - edits / (most + 1) >= SAME_TOWN / 2
    return (a == "") | (b == "") | ((F.abs(F.length(a) - F.length(b)) <= forgiven) & (F.levenshtein(a, b) <= forgiven * 2))


def scored_pairs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(left_id, right_side, right_id, confidence, name_sim, town_sim, capacity_sim) of the compared pairs, each once."""
    pairs = neighbour_pairs(rows, window).where(_may_share_town(F.col("left.town"), F.col("right.town")))
    pairs = pairs.groupBy(F.col("left.id").alias("left_id"), F.col("right.side").alias("right_side"), F.col("right.id").alias("right_id")).agg(
        F.first("left").alias("l"), F.first("right").alias("r")
    )
    flat = pairs.select("left_id", "right_side", "right_id", "l.words", "l.town", "l.capacity", F.col("r.words").alias("words2"), F.col("r.town").alias("town2"), F.col("r.capacity").alias("capacity2"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Towns too unlike give confidence 0 whatever the rest, so those pairs are left out before names are compared.
            out = [
                (a, s, b, *compare_words(w1.split(), t1, c1, w2.split(), t2, c2))
                for a, s, b, w1, t1, c1, w2, t2, c2 in pdf.itertuples(index=False, name=None)
                if not t1 or not t2 or likeness(t1, t2) >= SAME_TOWN / 2
            ]
            yield pd.DataFrame(out, columns=["left_id", "right_side", "right_id", "confidence", "name_sim", "town_sim", "capacity_sim"])

    return flat.mapInPandas(run, "left_id long, right_side int, right_id long, confidence double, name_sim double, town_sim double, capacity_sim double")


def best_assignment(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Indexes of the pairs (a, b) of a one-to-one choice with the greatest total gain.

    Exact: shortest augmenting paths over the given pairs alone, with a column of its own for each row, since it may
    stay without partner.
    """
    rows, i = np.unique(a, return_inverse=True)
    columns, j = np.unique(b, return_inverse=True)
    n, m = len(rows), len(columns)
    near: list[list[tuple[int, float, int]]] = [[(m + r, 0.0, -1)] for r in range(n)]
    for k, (r, c, g) in enumerate(zip(i.tolist(), j.tolist(), gain.tolist(), strict=True)):
        near[r].append((c, -g, k))
    u = [min(cost for _, cost, _ in options) for options in near]
    v = [0.0] * (m + n)
    holder, held, chosen = [-1] * (m + n), [-1] * n, [-1] * n
    for start in range(n):
        far: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        done: list[int] = []
        settled: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        while True:
            for c, cost, k in near[row]:
                at = base + cost - u[row] - v[c]
                if c not in settled and at < far.get(c, np.inf):
                    far[c], way[c] = at, (row, k)
                    heappush(heap, (at, c))
            base, column = heappop(heap)
            while column in settled:
                base, column = heappop(heap)
            settled.add(column)
            if holder[column] < 0:
                break
            done.append(column)
            row = holder[column]
        u[start] += base
        for c in done:
            u[holder[c]] += base - far[c]
            v[c] -= base - far[c]
        while True:
            row, k = way[column]
            before = held[row]
            holder[column], held[row], chosen[row] = row, column, k
            if row == start:
                break
            column = before
    return np.array(sorted(k for k in chosen if k >= 0), dtype=int)


def auction(pairs: DataFrame, least: float = RAISE) -> DataFrame:
    """(left_id, right_id, confidence): a one-to-one choice whose total is at most ``least`` a row under the greatest.

    Rows on the left without partner bid, all at once, for the row on the right that is worth most after its price:
    so much more as it is worth above the next best, or above staying alone, and ``least`` on top. Each row on the
    right goes to its highest bid (ties to the lesser id), at that price. A row that nothing is worth its price to
    leaves for good, as prices only rise; when nobody bids the prices prove the bound. A round is two joins and two
    aggregations over the open bids; prices are one row for each row on the right.
    """
    prices = materialise(pairs.select("right_id").distinct().select("right_id", F.lit(0.0).alias("price"), F.lit(None).cast("long").alias("holder")), "prices")
    rest = materialise(pairs.select("left_id", "right_id", "confidence"), "bidders")
    best_two = Window.partitionBy("left_id").orderBy(F.col("worth").desc(), "right_id")
    while True:
        free = rest.join(prices.where("holder is not null").select(F.col("holder").alias("left_id")), "left_id", "left_anti")
        worth = free.join(prices, "right_id").withColumn("worth", F.col("confidence") - F.col("price")).where("worth > 0")
        ranked = worth.withColumn("rank", F.row_number().over(best_two)).where("rank <= 2")
        bids = ranked.groupBy("left_id").agg(
            F.max(F.when(F.col("rank") == 1, F.struct("right_id", "price", "worth"))).alias("b"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("worth"))), F.lit(0.0)).alias("next")
        )
        bid = (F.col("b.price") + F.col("b.worth") - F.col("next") + least).alias("bid")
        won = materialise(bids.select(F.col("b.right_id").alias("right_id"), F.struct(bid, (-F.col("left_id")).alias("l")).alias("o")).groupBy("right_id").agg(F.max("o").alias("o")), "bids")
        if not won.take(1):
            break
        raised = prices.join(won, "right_id", "left").select("right_id", F.coalesce("o.bid", "price").alias("price"), F.coalesce(-F.col("o.l"), "holder").alias("holder"))
        following = materialise(raised, "prices")
        forget(prices, won)
        prices = following
    held = prices.where("holder is not null").select(F.col("holder").alias("left_id"), "right_id")
    return rest.join(held, ["left_id", "right_id"])


def assign(pairs: DataFrame, task_pairs: int = TASK_PAIRS, least: float = RAISE) -> DataFrame:
    """(left_id, right_id, confidence): a one-to-one choice of ``pairs`` with the greatest total confidence.

    Components of the pair graph are independent. Up to ``task_pairs`` pairs each is solved exactly in a task; larger
    ones go, all together and over all tasks, to the ``auction``, whose total is at most ``least`` for each left row
    under the greatest. Repeated pairs count once, with their highest confidence.
    """
    pairs = materialise(pairs.groupBy("left_id", "right_id").agg(F.max("confidence").alias("confidence")), "accepted")
    # Left vertices are even numbers and right ones odd.
    edges = pairs.select((F.col("left_id") * 2).alias("u"), (F.col("right_id") * 2 + 1).alias("v"))
    roots = component_roots(edges, slots=1)
    grouped = pairs.join(roots, F.col("left_id") * 2 == F.col("vertex"), "left").select("left_id", "right_id", "confidence", F.coalesce("root", F.col("left_id") * 2).alias("root"))
    counted = materialise(grouped.join(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root"), "counted")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["left_id", "right_id"])
        keep = best_assignment(pdf["left_id"].to_numpy(), pdf["right_id"].to_numpy(), pdf["confidence"].to_numpy())
        return pdf.iloc[keep][["left_id", "right_id", "confidence"]]

    out = counted.where("n = 1").select("left_id", "right_id", "confidence")
    out = out.unionByName(counted.where((F.col("n") > 1) & (F.col("n") <= task_pairs)).groupBy("root").applyInPandas(solve, "left_id long, right_id long, confidence double"))
    large = counted.where(F.col("n") > max(task_pairs, 1))
    return out.unionByName(auction(large, least)) if large.take(1) else out
