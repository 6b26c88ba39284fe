"""Top-k theta joins that skip what bounds rule out.

Candidates are filed in groups (columns that decide whether a source may meet them).  Sources
are known by signatures (columns that decide which groups they meet and the word terms of a pair).

1. Each source signature meets the groups, a small table, by equi joins; how many of its words
   a group's foods hold at all bounds the word terms.
2. Each source goes to the group of its own kind: its k-th score there is its floor.
3. A source goes on to those groups whose bound reaches its floor, and to no others.
4. The k best of what was found in all groups are its answer.

A task gets up to SOURCES sources and up to CANDIDATES candidates of one group.  There
candidates are cut into leaves of like numbers, a leaf's score bound is interval arithmetic for many sources
at once, and only candidates of leaves that reach the floor are scored.  A source is shuffled once for
each group it goes to, whatever the number of leaves; pairs never leave the task, only a source's best k.

The result is that of scoring every pair; bounds are widened by a millionth for
rounding.  Sources without a floor go to all groups that may hold a candidate.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from larder.sources.scratch import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

SLACK = 1e-6
#: Rows of a task, rows of a leaf, matrix cells and pairs that a task holds at once.
SOURCES, CANDIDATES, LEAF, MATRIX, PAIRS = 65536, 262144, 24, 2_000_000, 1_000_000

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Ranker:
    """Scores over arrays, of sources ``s`` and candidates ``c`` by column name; what the tasks run."""

    source: list[str]  #: sources' numbers
    numbers: list[str]  #: candidates' numbers
    kind: str  #: source number that is equal in all sources scored together
    split: list[str]  #: candidates' numbers by which leaves are cut, in turn
    words: list[str]  #: columns of both with whole numbers for words
    marks: list[str]  #: columns of both that word terms use besides
    terms: Callable[[Arrays, Arrays], Arrays]  #: terms of different sources (rows) and candidates (columns) by words and marks
    limits: list[str]  #: the numbers of both that may uses
    may: Callable[[Arrays, Arrays], np.ndarray]  #: whether s may take a candidate with these greatest numbers; exact for one candidate
    bound: Callable[[Arrays, Arrays, Arrays, Arrays, Arrays], np.ndarray]  #: of s, least and greatest numbers, least and greatest terms
    score: Callable[[Arrays, Arrays, Arrays], np.ndarray]  #: exact score of s, c and their terms


@dataclass(frozen=True)
class Rule:
    """How sources ``s`` and candidates ``c`` are compared; both are struct columns."""

    group: list[str]  #: candidates' columns of a group, which sources have too
    signature: list[str]  #: sources' columns that meets and loose use
    meets: list[Column]  #: conditions between s and the group columns of c, no two true together, each with an equality
    words: str  #: the column of words that pairs share, by hash
    repeats: bool  #: whether a candidate's words count as often as they stand there, not a source's
    possible: Column  #: whether s may take a candidate of the ranges c.low_*, c.high_*
    loose: dict[str, Column]  #: bounds of the word terms by group, of s, c and the most shared words t_shared
    parts: Callable[[Callable[[str], Column]], dict[str, Column]]  #: what the score bound is made of, given the terms by name
    upper: Column  #: score bound, of the parts in the struct column p
    ranker: Ranker


def _key(columns: list[str]) -> Column:
    """A number for the values of ``columns``; nulls count with their place."""
    return F.xxhash64(*columns, *(F.col(c).isNull() for c in columns))


def _reaches(bound: Column, floor: Column) -> Column:
    return floor.isNull() | (bound + SLACK * (1 + F.abs(bound)) >= floor)


def _met_groups(signatures: DataFrame, candidates: DataFrame, rule: Rule) -> DataFrame:
    """signature_no, group_no, c (the group's columns and ranges), t_shared (the most words shared): which groups a source signature meets."""
    ranges = [x for n in rule.ranker.numbers for x in (F.min(n).alias(f"low_{n}"), F.max(n).alias(f"high_{n}"))]
    groups = cut(candidates.groupBy("group_no").agg(*(F.first(g).alias(g) for g in rule.group), *ranges))
    groups = groups.select("group_no", F.struct(*(c for c in groups.columns if c != "group_no")).alias("c"))
    s = cut(signatures.select("signature_no", F.col(rule.words).alias("words"), F.struct(*rule.signature).alias("s")))
    pairs = s.join(groups, rule.meets[0])
    for condition in rule.meets[1:]:
        pairs = pairs.unionByName(s.join(groups, condition))
    pairs = cut(pairs.select("signature_no", "group_no", "c"))

    def held(frame: DataFrame, key: str, n: str) -> DataFrame:
        """How often a word stands in one row of ``key`` at most."""
        words = frame.select(key, "words", F.explode(F.array_distinct("words")).alias("word"))
        return words.groupBy(key, "word").agg(F.max(F.size(F.filter("words", lambda w: w == F.col("word")))).alias(n))

    asked, offered = held(s, "signature_no", "n_asked"), held(candidates.select("group_no", F.col(rule.words).alias("words")).distinct(), "group_no", "n_offered")
    shared = pairs.select("signature_no", "group_no").join(asked, "signature_no").join(offered, ["group_no", "word"])
    shared = shared.groupBy("signature_no", "group_no").agg(F.sum("n_offered" if rule.repeats else "n_asked").alias("t_shared"))
    return pairs.join(shared, ["signature_no", "group_no"], "left").withColumn("t_shared", F.coalesce("t_shared", F.lit(0)))


def _leaves(c: Arrays, by: list[str], words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the candidates, starts of their leaves): names with many foods apart, then halved by one number after the other."""
    n = len(words_of)
    many = n >= LEAF * (words_of.max() + 1)
    node = np.unique(words_of, return_inverse=True)[1] if many else np.zeros(n, np.int64)
    turn = 0
    while True:
        size = np.bincount(node)
        if size.max() <= LEAF:
            break
        order = np.lexsort((c[by[turn % len(by)]], node))
        starts = np.cumsum(size) - size
        place = np.arange(n) - starts[node[order]]
        upper = (place * 2 >= size[node[order]]) & (size[node[order]] > LEAF)
        halved = np.empty(n, np.int64)
        halved[order] = node[order] * 2 + upper
        node = np.unique(halved, return_inverse=True)[1]
        turn += 1
    order = np.argsort(node, kind="stable")
    return order, np.flatnonzero(np.diff(node[order], prepend=-1))


def _first_k(of: np.ndarray, score: np.ndarray, ord_: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each source, ties to the smaller order; in order of sources and ranks."""
    order = np.lexsort((ord_, np.where(np.isnan(score), -np.inf, -score), of))
    of = of[order]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    rank = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
    return order[rank < k]


def _search(s: Arrays, c: Arrays, s_words: Arrays, c_words: Arrays, ranker: Ranker, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(source, candidate, score) of each source's k best that reach its floor, and how many pairs were scored.

    s, c: numbers by row, with ``words`` the row of s_words, c_words (different words and marks).
    """
    order, starts = _leaves(c, ranker.split, c["words"])
    c = {n: x[order] for n, x in c.items()}
    sizes = np.diff(starts, append=len(order))
    low, high = ({n: f.reduceat(c[n], starts) for n in ranker.numbers} for f in (np.minimum, np.maximum))
    line = np.lexsort((s["words"], s[ranker.kind]))
    found, n_scored, at = [], 0, 0
    while at < len(line):
        # as many sources of one kind as fit
        end = min(at + max(1, MATRIX // max(len(starts), 1)), at + 1024, len(line))
        batch = line[at:end]
        other = np.flatnonzero(s[ranker.kind][batch] != s[ranker.kind][batch[0]])
        batch = batch[: other[0]] if len(other) else batch
        names, name = np.unique(s["words"][batch], return_inverse=True)
        fit = max(1, 2 * MATRIX // len(order))
        if len(names) > fit:
            batch = batch[: np.argmax(name >= fit)]
            names, name = names[:fit], name[: len(batch)]
        at += len(batch)
        term = ranker.terms({n: x[names] for n, x in s_words.items()}, c_words)
        spread = {n: x[:, c["words"]] for n, x in term.items()}
        t_low, t_high = ({n: f.reduceat(x, starts, axis=1)[name] for n, x in spread.items()} for f in (np.minimum, np.maximum))
        flat = {n: s[n][batch] for n in ranker.source}
        mine = {n: x[:, None] for n, x in flat.items()}
        bounds = ranker.bound(mine, low, high, t_low, t_high)
        bounds = np.where(np.isnan(bounds), np.inf, bounds + SLACK * (1 + np.abs(bounds)))
        bounds[~ranker.may(mine, high)] = -np.inf
        floor = s["floor"][batch]

        def scored(rows: np.ndarray, leaves: np.ndarray) -> list[tuple[np.ndarray, ...]]:
            """Allowed pairs of the batch's rows with the candidates of leaves, those that reach the floor."""
            kept, n = [], 0
            upto = np.cumsum(sizes[leaves])
            piece = 0
            while piece < len(rows):
                stop = max(piece + 1, int(np.searchsorted(upto, (upto[piece - 1] if piece else 0) + PAIRS, "right")))
                r, leaf = rows[piece:stop], leaves[piece:stop]
                many = sizes[leaf]
                row = np.repeat(r, many)
                col = np.repeat(starts[leaf] - np.cumsum(many) + many, many) + np.arange(many.sum())
                both = ranker.may({n: flat[n][row] for n in ranker.limits}, {n: c[n][col] for n in ranker.limits})
                both &= (s["id"][batch][row] != c["id"][col]) & ~term["barred"][name[row], c["words"][col]]
                row, col = row[both], col[both]
                value = ranker.score({n: x[row] for n, x in flat.items()}, {n: c[n][col] for n in ranker.numbers}, {n: x[name[row], c["words"][col]] for n, x in term.items()})
                n += len(row)
                reach = ~(value < floor[row])
                kept.append((row[reach], col[reach], value[reach]))
                piece = stop
            nonlocal n_scored
            n_scored += n
            return kept

        def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            row, col, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
            keep = _first_k(row, value, c["order"][col], k)
            return row[keep], col[keep], value[keep]

        # the leaves of the highest bounds first, twice as many each time: the k-th score in them raises the floor
        ahead = np.argsort(-bounds, axis=1)
        held = best([(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)])
        done, width = 0, 1 + k // LEAF
        while done < len(starts):
            leaves = ahead[:, done : done + width]
            rows, leaves = np.repeat(np.arange(len(batch)), leaves.shape[1]), leaves.ravel()
            reach = bounds[rows, leaves]
            live = (reach > -np.inf) & ~(reach < floor[rows])
            if not live.any():
                break  # what follows is bounded lower still
            held = best([held, *scored(rows[live], leaves[live])])
            count = np.bincount(held[0], minlength=len(batch))
            full = np.flatnonzero(count >= k)
            floor[full] = np.fmax(floor[full], held[2][np.cumsum(count)[full] - 1])
            done, width = done + width, 2 * width
        row, col, value = held
        found.append((batch[row], order[col], value))
    return *(np.concatenate([f[i] for f in found]) for i in range(3)), n_scored


def _different(table: pa.Table, numbers: list[str], words: list[str], marks: list[str]) -> tuple[Arrays, dict[str, list]]:
    """Numbers by row, and words and marks of the different ``words_no``."""
    _, first, at = np.unique(table["words_no"].to_numpy(), return_index=True, return_inverse=True)
    held = table.select([*words, *marks]).take(pa.array(first))
    arrays = {n: table[n].to_numpy(zero_copy_only=False).astype(float) for n in numbers}
    return arrays | {"words": at}, {n: held[n].to_pylist() for n in held.column_names}


def _counted(s: list[list[int]], c: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How often each word stands in each row, over the words of the sources."""
    place = {w: i for i, w in enumerate(sorted({w for row in s for w in row or ()}))}
    made = tuple(np.zeros((len(rows), max(len(place), 1))) for rows in (s, c))
    for rows, out in zip((s, c), made, strict=True):
        at = [(i, place[w]) for i, row in enumerate(rows) for w in row or () if w in place]
        if at:
            np.add.at(out, tuple(np.array(at).T), 1)
    return made


def _searcher(ranker: Ranker, k: int, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        s, s_marks = _different(left, ranker.source, ranker.words, ranker.marks)
        c, c_marks = _different(right, ranker.numbers, ranker.words, ranker.marks)
        s_words, c_words = ({n: np.array(rows[n], dtype=object) for n in ranker.marks} for rows in (s_marks, c_marks))
        for w in ranker.words:
            s_words[w], c_words[w] = _counted(s_marks[w], c_marks[w])
        ids = pa.chunked_array([*left["source"].chunks, *right["c_id"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        s["id"], c["id"], c["order"] = ids[: left.num_rows], ids[left.num_rows :], right["c_order"].to_numpy()
        s["floor"] = left["floor"].fill_null(-np.inf).to_numpy()
        source, candidate, score, n = _search(s, c, s_words, c_words, ranker, k)
        first = np.flatnonzero(np.diff(source, prepend=-1))
        rank = np.arange(len(source)) - np.repeat(first, np.diff(first, append=len(source))) + 1
        taken = right.take(pa.array(candidate))
        columns = {"source": left["source"].take(pa.array(source)), "score": pa.array(score), "place": pa.array(rank), "n_scored": pa.nulls(len(source), pa.int64())}
        columns |= {f.name: taken[f.name] for f in schema if f.name not in columns}
        counted = {f.name: pa.array([n]) if f.name == "n_scored" else pa.nulls(1, f.type) for f in schema}  # a row without a source
        return pa.concat_tables([pa.table(columns).select(schema.names).cast(schema), pa.table(counted, schema=schema)])

    return search


def best_by_bounds(sources: DataFrame, candidates: DataFrame, rule: Rule, k: int, *, id_col: str = "id", order_col: str = "row_ord", carried: tuple[str, ...] = (), counts: dict[str, int] | None = None) -> DataFrame:
    """source, c (the candidate's id, order and ``carried``), score, rank: each source's k best allowed candidates, ties to the smaller ``order_col``.

    ``counts``: if given, gets how many groups sources went to and how many exact scores were computed there.
    """
    ranker = rule.ranker
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = [*ranker.words, *ranker.marks]
    sent = ["source", "floor", "words_no", *dict.fromkeys([*marked, *ranker.source])]
    asking = sources.where(F.col(id_col).isNotNull()).withColumn("source", F.col(id_col))
    asking = asking.withColumns({"signature_no": _key(rule.signature), "own_group": _key(rule.group), "words_no": _key(marked), "floor": F.lit(None).cast("double")})
    filed = candidates.where(F.col(id_col).isNotNull()).withColumns({"group_no": _key(rule.group), "words_no": _key(marked)})
    met = cut(_met_groups(asking.dropDuplicates(["signature_no"]), filed, rule))
    asking = cut(asking.select("signature_no", "own_group", *dict.fromkeys([*sent, *rule.signature])))

    in_parts = cut(filed.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).select("group_no", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("n_parts")))
    offered = filed.select("group_no", "words_no", *dict.fromkeys([*marked, *ranker.numbers]), F.col(id_col).alias("c_id"), F.col(order_col).alias("c_order"), *(F.col(x).alias(f"c_{x}") for x in carried))
    offered = cut(offered.join(in_parts, "group_no").withColumn("part", F.pmod(F.xxhash64("c_id"), F.col("n_parts")).cast("int")).drop("n_parts"))
    found = ["c_id", "c_order", *(f"c_{x}" for x in carried)]
    result = StructType([asking.schema["source"], *asking.select(F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("n_scored")).schema, *(offered.schema[x] for x in found)])
    result = StructType([StructField(f.name, f.dataType) for f in result])
    keys = ["group_no", "part", "chunk"]

    def searched(going: DataFrame) -> DataFrame:
        """The best k of each source in each group that it goes to."""
        in_chunks = cut(going.groupBy("group_no").agg(F.count(F.lit(1)).alias("n")).select("group_no", F.ceil(F.col("n") / SOURCES).cast("int").alias("n_chunks")))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = going.join(in_chunks.join(in_parts, "group_no"), "group_no").withColumns({"chunk": F.pmod(F.xxhash64("source"), F.col("n_chunks")).cast("int"), "part": upto("n_parts")})
        right = offered.join(in_chunks, "group_no").withColumn("chunk", upto("n_chunks")).drop("n_chunks")
        left, right = (side.repartition(tasks, *keys).groupBy(*keys) for side in (left.select(*keys, *sent), right))
        return cut(left.cogroup(right).applyInArrow(_searcher(ranker, k, to_arrow_schema(result)), result))

    own = met.select("signature_no", F.col("group_no").alias("own_group"))
    at_home = asking.join(own, ["signature_no", "own_group"]).select(F.col("own_group").alias("group_no"), *sent)
    first = searched(at_home)
    floors = first.where(F.col("place") == k).groupBy("source").agg(F.max("score").alias("floor"))
    terms = {f"t_{n}": t for n, t in rule.loose.items()}
    further = asking.drop("floor").join(floors, "source", "left").join(met, "signature_no").where(F.col("group_no") != F.col("own_group"))
    further = further.withColumn("s", F.struct(*dict.fromkeys([*rule.signature, *ranker.source]))).where(rule.possible).withColumns(terms)
    further = further.withColumn("p", F.struct(*(x.alias(n) for n, x in rule.parts(lambda n: F.col(f"t_{n}")).items()))).where(_reaches(rule.upper, F.col("floor")))
    further = cut(further.select("group_no", *sent))
    second = searched(further)
    if counts is not None:
        scored = lambda frame: frame.agg(F.coalesce(F.sum("n_scored"), F.lit(0))).first()[0]
        counts |= {"home": at_home.count(), "groups": further.count(), "seeds": scored(first), "pairs": scored(second)}
    both = first.unionByName(second).where(F.col("source").isNotNull())
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), F.col("c_order")))
    best = both.withColumn("rank", place).where(F.col("rank") <= k)
    named = [F.col("c_id").alias(id_col), F.col("c_order").alias(order_col), *(F.col(f"c_{x}").alias(x) for x in carried)]
    return best.select("source", F.struct(*named).alias("c"), "score", "rank")
