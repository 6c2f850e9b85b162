"""Joins that link records: shared ids, name tokens, contained texts, tiers of lookups and unions of pair lists."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.text import indel_to, token_set_score, tokens


def shared_id_links(rows: DataFrame, key: str, source: str, ids: Mapping[str, Column], across_sources: bool = True) -> DataFrame:
    """(left, right, method): each row with the least row that shares an id, for every named id.

    ``ids`` maps a method to a column or an array of ids; null and empty ids link nothing. A group of rows becomes a
    star and not all its pairs, which says the same: whoever shares an id is in one group. With ``across_sources``
    groups of one source only link nothing.
    """
    keyed = []
    for method, c in ids.items():
        one = rows.select(F.col(key).alias("right"), F.col(source).alias("_s"), c.alias("_id"))
        listed = one.schema["_id"].dataType.typeName() == "array"
        each = one.select("right", "_s", (F.explode("_id") if listed else F.col("_id")).alias("_id")).withColumn("_id", F.col("_id").cast("string"))
        keyed.append(each.where(F.trim("_id") != "").withColumn("method", F.lit(method)))
    all_ = reduce(DataFrame.unionByName, keyed)
    least = all_.groupBy("method", "_id").agg(F.min("right").alias("left"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    least = least.where("_lo <> _hi") if across_sources else least
    return all_.join(least, ["method", "_id"]).where(F.col("left") != F.col("right")).select("left", "right", "method").distinct()


def name_block_pairs(rows: DataFrame, key: str, source: str, name: str, block: Sequence[str], least: int = 4, most: int | None = 60) -> tuple[DataFrame, DataFrame]:
    """Pairs (left, right) across sources of rows that share the block and the first word of ``least`` letters; and the
    rows (key) of the blocks left out.

    Blocks above ``most`` rows say too little and are left out; those rows come back, so that another rule can take
    them. With ``most`` None all blocks are paired.
    """
    word = F.try_element_at(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: F.length(w) >= least), F.lit(1))
    blocked = rows.select(F.col(key).alias("id"), F.col(source).alias("_s"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(block)], word.alias("_w")).where("_w is not null")
    by = [*[f"_b{i}" for i in range(len(block))], "_w"]
    sizes = blocked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    usable = sizes.where("_n >= 2 and _lo <> _hi")
    small = usable.where(F.col("_n") <= most) if most is not None else usable
    inside = blocked.join(small.select(*by), by)
    left, right = inside.select(*by, F.col("id").alias("left"), F.col("_s").alias("_sl")), inside.select(*by, F.col("id").alias("right"), F.col("_s").alias("_sr"))
    pairs = left.join(right, by).where((F.col("left") < F.col("right")) & (F.col("_sl") != F.col("_sr"))).select("left", "right")
    large = sizes.where(F.col("_n") > most) if most is not None else sizes.limit(0)
    return pairs, blocked.join(large.select(*by), by).select(F.col("id").alias(key))


def containing(texts: DataFrame, text_key: str, text: str, needles: DataFrame, needle_key: str, needle: str) -> DataFrame:
    """(text_key, needle_key): texts that contain a needle as whole words, whatever the case.

    Instead of comparing all with all, the longest word of a needle is joined to the words of the texts and the rest
    is tested on those that share it. Needles without a word match nothing.
    """
    plain = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))
    longest = lambda ws: F.element_at(F.array_sort(F.transform(ws, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)["w"]
    n = needles.select(F.col(needle_key), plain(F.col(needle)).alias("_needle")).where("_needle <> '  ' and trim(_needle) <> ''")
    n = n.withColumn("_w", longest(F.split(F.trim("_needle"), " ")))
    t = texts.select(F.col(text_key), plain(F.col(text)).alias("_text")).where("_text is not null")
    words = t.select(text_key, F.explode(F.array_distinct(F.split(F.trim("_text"), " "))).alias("_w"))
    near = words.join(n, "_w").select(text_key, needle_key, "_needle")
    return near.join(t, text_key).where(F.contains(F.col("_text"), F.col("_needle"))).select(text_key, needle_key).distinct()


def fuzzy_names(left: DataFrame, left_key: str, right: DataFrame, right_key: str, name: str, threshold: float) -> DataFrame:
    """(left_key, right_key, score): rows whose names reach the token-set ``threshold``.

    Each distinct name is compared once, by ``alike_names``, whether or not names share a word, and then handed to all rows that bear it.
    """
    scored = alike_names(left.select(F.col(name).alias("_l")), right.select(F.col(name).alias("_r")), [], None, threshold)
    return scored.join(left.select(left_key, F.col(name).alias("_l")), "_l").join(right.select(right_key, F.col(name).alias("_r")), "_r").select(left_key, right_key, "score")


def united_pairs(*lists: DataFrame) -> DataFrame:
    """(left, right, methods, score) of several lists (left, right, method, score): each pair once, its methods joined by
    + in order and its best score."""
    all_ = reduce(DataFrame.unionByName, [x.select("left", "right", "method", "score") for x in lists])
    return all_.groupBy("left", "right").agg(F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"), F.max("score").alias("score"))


def overlaid(older: DataFrame, newer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``older`` with the rows of ``newer`` in place of its rows of the same key, and its further rows."""
    return older.join(newer.select(*keys), list(keys), "left_anti").unionByName(newer)


def first_found(rows: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]], value: str) -> DataFrame:
    """``rows`` with ``value`` and ``tier``: from the first lookup (name, table, keys) that has the row's keys.

    Every lookup is one left equi-join on its own keys; a key that a lookup holds with two values is not in it.
    """
    out = rows
    for i, (_, lookup, keys) in enumerate(tiers):
        one = lookup.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(f"_lo{i}"), F.max(value).alias(f"_hi{i}")).where(f"_lo{i} = _hi{i}").drop(f"_hi{i}")
        out = out.join(one, list(keys), "left")
    found = [F.col(f"_lo{i}") for i in range(len(tiers))]
    tier = reduce(lambda c, x: c.when(F.col(f"_lo{x[0]}").isNotNull(), x[1][0]), enumerate(tiers), F)
    return out.withColumns({value: F.coalesce(*found), "tier": tier}).drop(*[f"_lo{i}" for i in range(len(tiers))])


def by_any_name(rows: DataFrame, key: str, name: str, aliases: str, norm) -> DataFrame:  # noqa: ANN001
    """(norm_key, key): every normalised name or alias with the rows that bear it."""
    each = rows.select(F.col(key), F.explode(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("_n"))
    return each.select(norm(F.col("_n")).alias("norm_key"), key).where("norm_key is not null").distinct()


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): ``both``, or the side that alone has the key."""
    a, b = left.select(key).distinct().withColumn("_a", F.lit(1)), right.select(key).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def tiered_names(queries: DataFrame, nodes: DataFrame, block: str, name: str, node: str, volts: str, threshold: float, margin: float) -> DataFrame:
    """(block, name, node, tier, score): each distinct query name with its node in the block.

    Equal names first, if only one node has it and a voltage both state agrees; then the best score of at least
    ``threshold`` that leads the next node by ``margin``. Everything else is refused: tier ``ambiguous`` or ``none``.
    """
    q = queries.select(block, name, volts).distinct()
    n = nodes.select(F.col(block), F.col(name).alias("_name"), F.col(node).alias("node"), F.col(volts).alias("_v"))
    fits = F.col(volts).isNull() | F.col("_v").isNull() | (F.col(volts) == F.col("_v"))
    exact = q.join(n, block).where((F.col(name) == F.col("_name")) & fits).groupBy(block, name, volts).agg(F.min("node").alias("_e"), F.count_distinct("node").alias("_n"))
    rest = q.join(exact.select(F.col(block).alias("_b"), F.col(name).alias("_q"), F.col(volts).alias("_w")), (F.col(block) == F.col("_b")) & (F.col(name) == F.col("_q")) & F.col(volts).eqNullSafe(F.col("_w")), "left_anti")
    alike = alike_names(rest.select(block, F.col(name).alias("_l")), n.select(block, F.col("_name").alias("_r")), [block], 3, threshold - margin)  # a lesser score neither wins nor hinders
    scored = alike.withColumnsRenamed({"_l": name, "_r": "_name"}).join(rest, [block, name]).join(n, [block, "_name"]).where(fits).groupBy(block, name, volts, "node").agg(F.max("score").alias("score"))
    w = Window.partitionBy(block, name, volts).orderBy(F.col("score").desc(), "node")
    best = scored.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)}).where((F.col("_r") == 1) & (F.col("score") >= threshold))
    clear = F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin)
    fuzzy = best.select(block, name, volts, F.when(clear, F.col("node")).alias("node"), F.when(clear, "fuzzy").otherwise("ambiguous").alias("tier"), "score")
    sure = exact.select(block, name, volts, F.when(F.col("_n") == 1, F.col("_e")).alias("node"), F.when(F.col("_n") == 1, "exact").otherwise("ambiguous").alias("tier"), F.lit(100.0).alias("score"))
    found = sure.unionByName(fuzzy).select(F.col(block).alias("_b"), F.col(name).alias("_q"), F.col(volts).alias("_w"), "node", "tier", "score")
    joined = q.join(found, (F.col(block) == F.col("_b")) & (F.col(name) == F.col("_q")) & F.col(volts).eqNullSafe(F.col("_w")), "left")
    return joined.select(block, name, volts, "node", F.coalesce("tier", F.lit("none")).alias("tier"), "score")


def one_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the only rule that fits, ``conflict`` where rules of different labels do, null where none does."""
    labels = F.array_distinct(F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), label) for p, label in rules])))
    return F.when(F.size(labels) == 1, labels[0]).when(F.size(labels) > 1, "conflict")


def first_veto(vetoes: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first veto that holds, in order; null where none does. An unknown veto does not hold."""
    return reduce(lambda c, v: c.when(v[1], v[0]), vetoes, F)


def parents_of(relations: DataFrame, entities: DataFrame, child: str, parent: str, entity: str, facts: Sequence[str]) -> DataFrame:
    """Relations with the ``facts`` of both ends as child_… and parent_…; relations with an unknown end are left out.

    Entities are cut to those some relation names before the joins, so one pass of a large register suffices.
    """
    wanted = relations.select(F.explode(F.array(child, parent)).alias(entity)).distinct()
    known = entities.select(entity, *facts).join(wanted, entity, "left_semi")
    side = lambda c, p: known.select(F.col(entity).alias(c), *[F.col(f).alias(f"{p}_{f}") for f in facts])
    return relations.join(side(child, "child"), child).join(side(parent, "parent"), parent)


#: Names that are compared together; the unit of work of ``alike_names`` is two such lists.
LIST_NAMES = 2048
#: Names of one list that meet the other at a time, so that what is in hand fits the cache.
SLICE_NAMES = 128


def alike_names(left: DataFrame, right: DataFrame, by: Sequence[str], least: int | None, threshold: float) -> DataFrame:
    """(by, _l, _r, score): distinct names ``_l`` and ``_r`` of one ``by`` that share a word of ``least`` letters and reach the token-set ``threshold``; with ``least`` None all that reach it.

    Lists of names meet lists, dealt evenly to the tasks. Two matrix products bound each score from above: the letters
    two names have in common, and the length of their shared words (words that fall together count as shared). Only
    pairs whose bound reaches the threshold are scored, so the result is that of scoring all.
    """
    def lists(df: DataFrame, name: str) -> DataFrame:
        named = df.where(F.col(name).isNotNull()).dropna(subset=list(by)).select(*by, name).distinct()
        words = named.select(*by, F.struct(F.col(name).alias("n"), *([] if least is None else [tokens(F.col(name), least).alias("w")])).alias("x"))
        words = words if least is None else words.where(F.size("x.w") > 0)
        sizes = words.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else words.agg(F.count(F.lit(1)).alias("_n"))
        cut = (words.join(sizes, list(by)) if by else words.crossJoin(F.broadcast(sizes))).withColumn("_cut", F.pmod(F.xxhash64("x.n"), F.ceil(F.col("_n") / LIST_NAMES)))
        return cut.groupBy(*by, "_cut").agg(F.collect_list("x").alias(f"{name}s")).drop("_cut")

    a, b = lists(left, "_l"), lists(right, "_r")
    spark = left.sparkSession
    two = (a.join(b, list(by)) if by else a.crossJoin(b)).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    kinds = [f"`{c}` {two.schema[c].dataType.simpleString()}" for c in by]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                xs, ys = list(row["_ls"]), list(row["_rs"])
                names_x, names_y = [x["n"] for x in xs], [y["n"] for y in ys]
                i, j, best = _may_reach(names_x, names_y, threshold)
                words_x, words_y = ([], []) if least is None else ([set(x["w"]) for x in xs], [set(y["w"]) for y in ys])
                sorted_y, found, last, lcs = [" ".join(sorted(n.lower().split())) for n in names_y], [], -1, None
                for p, q, m in zip(i.tolist(), j.tolist(), best.tolist(), strict=True):
                    if p != last:
                        last, lcs = p, indel_to(" ".join(sorted(names_x[p].lower().split())))
                    # the sorted words alone settle most pairs, before the shared ones are looked at
                    if (least is None or not words_x[p].isdisjoint(words_y[q])) and m + lcs(sorted_y[q]) >= 2 * threshold - 0.01 and (s := token_set_score(names_x[p], names_y[q])) >= threshold:
                        found.append((names_x[p], names_y[q], s))
                out = pd.DataFrame(found, columns=["_l", "_r", "score"])
                for c in reversed(by):
                    out.insert(0, c, row[c])
                if found:
                    yield out

    return two.mapInPandas(run, ", ".join([*kinds, "_l string", "_r string", "score double"]))


def _may_reach(xs: Sequence[str], ys: Sequence[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in xs, in ys) of the pairs whose token-set score may reach ``threshold``, none that does left out; and the
    most that the part of shared words can be in each."""
    def facts(names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        letters, words = np.zeros((len(names), 64), np.int32), np.zeros((len(names), 128), np.float32)
        whole, once = np.zeros(len(names), np.float32), np.zeros(len(names), np.float32)
        for i, n in enumerate(names):
            ws = n.lower().split()
            text = " ".join(ws)
            letters[i] = np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 64, minlength=64)
            for w in set(ws):
                words[i, zlib.crc32(w.encode("utf-8", "surrogatepass")) % 128] += (len(w) + 1) ** 0.5
            whole[i], once[i] = len(text), len(" ".join(set(ws)))
        return letters, words, whole, once

    (la, wa, na, oa), (lb, wb, nb, ob) = facts(xs), facts(ys)
    most = np.minimum(la.max(0), lb.max(0))
    steps = lambda m: np.concatenate([m[:, [c]] >= np.arange(1, k + 1) for c, k in enumerate(most) if k] or [np.zeros((len(m), 1), bool)], axis=1).astype(np.float32)
    (sa, sb), n = (steps(la), steps(lb).T), na[:, None] + nb[None, :]
    ratio = lambda c, n: np.minimum(100, 200 * c / np.maximum(n, 1))
    some = lambda both, o: 200 * np.minimum(both, o) / np.maximum(np.minimum(both, o) + o, 1)
    out = []
    for at in range(0, len(xs), SLICE_NAMES):
        rows = slice(at, at + SLICE_NAMES)
        common = sa[rows] @ sb
        some_reach = np.flatnonzero(200 * common >= n[rows] * np.float32(2 * threshold - 100 - 0.03))  # the rest falls short even with equal shared words
        i, j = np.divmod(some_reach, len(ys))
        common, both = common.ravel()[some_reach], np.maximum((wa[rows] @ wb.T).ravel()[some_reach] - 1, 0)  # at least as long as the shared words with a space between
        o, p = oa[rows][i], ob[j]
        best = np.maximum(ratio(common, o + p), np.maximum(some(both, o), some(both, p)))
        near = (best + ratio(common, n[rows].ravel()[some_reach])) / 2 >= threshold - 0.01
        out.append((i[near] + at, j[near], best[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
