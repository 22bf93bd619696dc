"""Decision trees and forests grown from the term relation, level by level, all training sets at once.

A training set is a fold left out and a tree number. Every document stands at a node of each set's tree. Per level,
entries are counted by (set, node, term, weight) and class; running sums over the weights of a term, and the node's
totals for the documents without it, give every split's Gini score. So no vectors are built, absent weights never
become rows, and depth has no limit. Weights count at 6 digits, which bounds the values of a term at a node.
A node of few entries is finished with all that is below it in one task, so only large nodes take a level's jobs.

Trees that look at every term of every document once are grown from entries stored by term, each term's by weight: the
driver numbers the documents, a level sends every task the node of each, and no level shuffles entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import bounded, broadcast_checked, materialize, uniform
from .sample import label_codes

DIGITS = 6
# Levels that are grown when nothing else is said: until every node is pure or cannot be split.
NO_LIMIT = 1 << 30
# A node whose documents have at most so many entries is finished in one task.
TASK_ENTRIES = 1 << 20
# Documents, and documents times training sets, whose nodes the driver keeps and sends to the tasks.
COLUMN_DOCS, COLUMN_CELLS = 1 << 24, 1 << 26
# Chances that a Poisson draw of mean 1 is at most 0, 1, 2, ..
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


@dataclass
class Trees:
    nodes: DataFrame      # (set, node, n, term, threshold, score): class counts and split; null term for a leaf
    places: DataFrame     # (set, doc_id, y, test, node): where each document ended
    labels: list
    depth: int


def _counts(value: Column, n_classes: int, y: str = "y") -> list[Column]:
    return [F.sum(F.when(F.col(y) == k, value).otherwise(0)).alias(f"n{k}") for k in range(n_classes)]


def _score(counts: list[Column]) -> Column:
    """Sum of squared class counts over their total: the larger, the purer."""
    total = sum(counts[1:], counts[0])
    squares = sum([c * c for c in counts[1:]], counts[0] * counts[0])
    return squares.cast("double") / F.nullif(total, F.lit(0)).cast("double")


def _draws(seed: int) -> Column:
    u = uniform(seed, "draw", F.col("tree"), F.col("doc_id"))
    return sum([(u >= p).cast("long") for p in _POISSON], F.lit(0).cast("long"))


def grow(weights: DataFrame, docs: DataFrame, n_folds: int, n_trees: int = 1, subset: float = 1.0, bootstrap: bool = False,
         seed: int = 123, max_depth: int = NO_LIMIT, task_entries: int = TASK_ENTRIES) -> Trees:
    """Trees of (doc_id, fold, term, w) and (doc_id, label, fold) on every training set: all folds but one.

    With `n_trees`, each set grows several; `subset` is the share of terms that a node looks at, chosen by hash,
    and `bootstrap` draws each document a hashed Poisson number of times. Ties go to the smaller term, then to the
    larger weight. A document of a fold from `n_folds` on trains only. Labels of no document are unknown.
    Nodes of at most `task_entries` entries are finished in one task each, unless nodes look at a share of the terms.
    """
    codes = bounded(label_codes(docs))
    labels = [r["label"] for r in codes.orderBy("label_idx").collect()]
    k = range(len(labels))
    names = [f"n{i}" for i in k]
    # Entries and documents lie in the same buckets, so no level shuffles entries.
    entries = materialize(weights.select(F.col("doc_id").alias("_id"), F.col("fold").alias("_ef"), F.col("term").alias("_t"), F.round("w", DIGITS).alias("v"))
                          .where("v > 0"), key="_id")
    sets = F.explode(F.sequence(F.lit(0), F.lit(n_folds * n_trees - 1)))
    placed = docs.join(codes, "label").select("doc_id", F.col("fold").alias("_f"), F.col("label_idx").alias("y"), sets.alias("set")) \
        .withColumn("tree", F.col("set") % n_trees).withColumn("test", F.col("_f") == F.floor(F.col("set") / n_trees)) \
        .withColumn("times", F.when(F.col("test"), 0).otherwise(_draws(seed) if bootstrap else 1).cast("long")) \
        .where("test OR times > 0").withColumn("node", F.lit(""))
    sizes = entries.groupBy("_id", "_ef").agg(F.count("*").alias("size"))
    if subset >= 1.0 and not bootstrap and n_trees == 1:
        columns = _columns(entries, docs.join(codes, "label").select("doc_id", F.col("fold").alias("_f"), F.col("label_idx").alias("y")), sizes, n_folds)
        if columns is not None:
            return _grow_by_columns(entries, columns, labels, n_folds, max_depth, task_entries)
    here = materialize(placed.drop("tree").join(sizes, _same_document(), "left").drop("_id", "_ef").withColumn("size", F.coalesce("size", F.lit(1))), key="doc_id")
    nodes = ended = None
    depth = 0
    while True:
        at = ["set", "node"]
        totals = materialize(here.groupBy(*at).agg(*_counts(F.col("times"), len(labels)), F.sum("size").alias("load")))
        if subset >= 1.0:
            light = F.col("load") <= task_entries
            n_light, n_nodes = totals.agg(F.count(F.when(light, 1)), F.count("*")).first()
            if n_light:
                own = broadcast_checked(totals.where(light).select(*at))
                below = materialize(_finished(entries, here.join(own, at, "left_semi"), len(labels), max_depth))
                rows, places = below.where("kind = 'node'"), below.where("kind = 'place'").select("set", "doc_id", "y", "test", "node")
                rows = rows.select("set", "node", "n", "term", "threshold", "score")
                nodes, ended = (rows, places) if nodes is None else (nodes.unionByName(rows), ended.unionByName(places))
                if n_light == n_nodes:
                    return Trees(nodes, ended, labels, nodes.agg(F.max(F.length("node"))).first()[0] or 0)
                here = here.join(own, at, "left_anti")
                totals = totals.where(~light)
        mixed = sum([(F.col(n) > 0).cast("int") for n in names], F.lit(0)) > 1
        live = broadcast_checked(totals.where(mixed).select(F.col("set").alias("_s"), F.col("node").alias("_n"), *[F.col(n).alias(f"all{i}") for i, n in enumerate(names)]))
        best = broadcast_checked(_best_splits(entries, here, live, len(labels), subset, seed)) if depth < max_depth else None
        level = totals.select("set", "node", F.array(*names).alias("n"))
        none = F.lit(None)
        if best is None:
            rows = level.withColumns({"term": none.cast("string"), "threshold": none.cast("double"), "score": none.cast("double")})
        else:
            rows = level.join(best, (F.col("set") == F.col("_s")) & (F.col("node") == F.col("_n")), "left").drop("_s", "_n")
        rows = materialize(rows)
        nodes = rows if nodes is None else nodes.unionByName(rows)
        split = rows.where("term IS NOT NULL")
        joined = here.join(broadcast_checked(split.select(F.col("set").alias("_s"), F.col("node").alias("_n"), "term", "threshold")),
                           (F.col("set") == F.col("_s")) & (F.col("node") == F.col("_n")), "left").drop("_s", "_n")
        done = joined.where("term IS NULL").select("set", "doc_id", "y", "test", "node")
        ended = done if ended is None else ended.unionByName(done)
        if rows.where("term IS NOT NULL").isEmpty():
            return Trees(nodes, ended, labels, nodes.agg(F.max(F.length("node"))).first()[0] or 0)
        moved = joined.where("term IS NOT NULL")
        right = moved.join(entries, _same_document() & (F.nullif(F.col("term"), F.col("_t")).isNull()), "left")
        side = F.when(F.col("v") > F.col("threshold"), "r").otherwise("l")
        here = materialize(right.select("doc_id", "_f", "y", "set", "test", "times", "size", F.concat("node", side).alias("node")), key="doc_id")
        depth += 1


def _same_document() -> Column:
    # A difference is no key of the join: keys beside the document's would ask for another partitioning.
    return (F.col("doc_id") == F.col("_id")) & (F.col("_f") - F.col("_ef") == 0)


def _best_splits(entries: DataFrame, here: DataFrame, live: DataFrame, n_classes: int, subset: float, seed: int) -> DataFrame:
    """(_s, _n, term, threshold, score): the best split of each live node that makes it purer."""
    k = range(n_classes)
    train = here.where("times > 0").join(live.select("_s", "_n"), (F.col("set") == F.col("_s")) & (F.col("node") == F.col("_n")), "left_semi")
    seen = train.select("doc_id", "_f", "y", "set", "node", "times").join(entries, _same_document()).withColumnRenamed("_t", "term")
    if subset < 1.0:
        chance = F.pmod(F.xxhash64(F.lit(seed), "set", "node", "term"), F.lit(1 << 30))
        seen = seen.where(chance < int(subset * (1 << 30)))
    cells = seen.groupBy("set", "node", "term", "v").agg(*_counts(F.col("times"), n_classes))
    down = Window.partitionBy("set", "node", "term").orderBy(F.col("v").desc())
    running = cells.select("set", "node", "term", "v", F.coalesce(F.lead("v").over(down), F.lit(0.0)).alias("below"),
                           *[F.sum(f"n{i}").over(down).alias(f"r{i}") for i in k])
    joined = running.join(live, (F.col("set") == F.col("_s")) & (F.col("node") == F.col("_n")))
    right, left, whole = [F.col(f"r{i}") for i in k], [F.col(f"all{i}") - F.col(f"r{i}") for i in k], [F.col(f"all{i}") for i in k]
    score = F.round(_score(right) + _score(left), 6)
    found = joined.select("_s", "_n", "term", ((F.col("v") + F.col("below")) / 2).alias("threshold"), F.col("v"), score.alias("score"), _score(whole).alias("before")) \
        .where("score IS NOT NULL AND score > before + 1e-6")
    best = found.groupBy("_s", "_n").agg(F.min(F.struct((-F.col("score")).alias("s"), "term", (-F.col("v")).alias("v"), "threshold")).alias("_b"))
    return best.select("_s", "_n", "_b.term", "_b.threshold", (-F.col("_b.s")).alias("score"))


@dataclass
class _Columns:
    """Entries by term, and the documents by number."""
    rows: DataFrame       # (terms, ptr, at, v): the entries of some terms, each term's by falling weight
    placed: DataFrame     # (doc_id, _f, y, size, at)
    fold: np.ndarray
    y: np.ndarray
    size: np.ndarray


def _column_part(t: pa.Table) -> pa.Table:
    coded = t["term"].combine_chunks().dictionary_encode()
    names = np.array(coded.dictionary.to_pylist(), object)
    by_name = np.argsort(names)
    place = np.empty(len(names), np.int64)
    place[by_name] = np.arange(len(names))
    code, at, v = place[coded.indices.to_numpy()], t["at"].to_numpy(), t["v"].to_numpy()
    twice = np.lexsort((at, code))
    twice = bool(((np.diff(code[twice]) == 0) & (np.diff(at[twice]) == 0)).any())
    order = np.lexsort((-v, code))
    ptr = np.searchsorted(code[order], np.arange(len(names) + 1))
    return pa.table({"terms": pa.array([names[by_name].tolist()], pa.list_(pa.string())), "twice": pa.array([twice]), **{
        c: pa.array([a.astype(k).tobytes()], pa.binary()) for c, a, k in (("ptr", ptr, "i8"), ("at", at[order], "i4"), ("v", v[order], "f8"))}}) \
        .select(["terms", "ptr", "at", "v", "twice"])


def _columns(entries: DataFrame, docs: DataFrame, sizes: DataFrame, n_sets: int) -> _Columns | None:
    """Entries stored by term; None if documents are too many, or if a document or an entry is there twice."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.join(sizes, _same_document(), "left").drop("_id", "_ef").withColumn("size", F.coalesce("size", F.lit(1)))
    dealt = materialize(sized.withColumn("b", F.pmod(F.xxhash64("doc_id", "_f"), F.lit(parts)).cast("int"))
                        .withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy("doc_id", "_f"))), key="doc_id")
    counts = sorted((r["b"], r["count"]) for r in dealt.groupBy("b").count().collect())
    n = sum(c for _, c in counts)
    if not 0 < n <= COLUMN_DOCS or n * n_sets > COLUMN_CELLS or not dealt.groupBy("doc_id", "_f").count().where("count > 1").isEmpty():
        return None
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    offsets = spark.createDataFrame([(b, k) for (b, _), k in zip(counts, before)], "b int, _before int")
    placed = dealt.join(F.broadcast(offsets), "b").select("doc_id", "_f", "y", "size", (F.col("at") + F.col("_before") - 1).cast("int").alias("at"))
    own = placed.select("at", "_f", "y", "size").toArrow()
    order = np.argsort(own["at"].to_numpy())
    fold, y, size = (own[c].to_numpy()[order] for c in ("_f", "y", "size"))
    n_parts = max(4 * spark.sparkContext.defaultParallelism, -(-int(size.sum()) // TASK_ENTRIES))
    cells = entries.join(placed.select("doc_id", "_f", "at"), _same_document()) \
        .select(F.pmod(F.xxhash64("_t"), F.lit(n_parts)).cast("int").alias("p"), F.col("_t").alias("term"), "at", "v")
    rows = materialize(cells.repartition(n_parts, "p").groupBy("p").applyInArrow(
        _column_part, "terms array<string>, ptr binary, at binary, v binary, twice boolean"))
    if not rows.where("twice").isEmpty():
        return None
    return _Columns(rows.drop("twice"), placed, fold, y, size)


def _column_batches(batches):
    for batch in batches:
        for i in range(len(batch)):
            terms, ptr, at, v = (batch.column(c)[i] for c in ("terms", "ptr", "at", "v"))
            yield terms.values, np.frombuffer(ptr.as_py(), "i8"), np.frombuffer(at.as_py(), "i4"), np.frombuffer(v.as_py(), "f8")


def _column_splits(state, docs):
    """(node, score, term, v, threshold): per live node, the best split by the terms of a row, if it makes the node purer."""
    def run(batches):
        node, whole = state.value
        fold, y = docs.value
        pure = _purity(whole) + 1e-6
        for terms, ptr, at, v in _column_batches(batches):
            code = np.repeat(np.arange(len(terms)), np.diff(ptr))
            for s, own in enumerate(node):
                nd = own[at]
                keep = np.flatnonzero((nd >= 0) & (fold[at] != s))
                if not len(keep):
                    continue
                # Entries of a term keep their order by weight inside a node.
                key = code[keep] * len(whole) + nd[keep]
                keep = keep[np.argsort(key, kind="stable")]
                key = code[keep] * len(whole) + nd[keep]
                w, of = v[keep], nd[keep]
                ones = np.zeros((len(keep), whole.shape[1]), np.int64)
                ones[np.arange(len(keep)), y[at[keep]]] = 1
                running = np.cumsum(ones, axis=0)
                new = np.append(True, key[1:] != key[:-1])
                last = np.flatnonzero(np.append(new[1:] | (w[1:] != w[:-1]), True))
                base = np.flatnonzero(new)[np.cumsum(new)[last] - 1]
                right = running[last] - np.where((base > 0)[:, None], running[base - 1], 0)
                key, w, of, term = key[last], w[last], of[last], code[keep[last]]
                below = np.append(w[1:], 0.0)
                below[np.append(key[1:] != key[:-1], True)] = 0.0
                score = _purity(right) + _purity(whole[of] - right)
                score = np.where(np.isnan(score), -np.inf, score)
                top = np.full(len(whole), -np.inf)
                np.maximum.at(top, of, score)
                near = np.flatnonzero(np.isfinite(score) & (score >= top[of] - 2e-6) & (score > pure[of] - 2e-6))
                rounded = _rounded(score[near])
                near, rounded = near[rounded > pure[of[near]]], rounded[rounded > pure[of[near]]]
                order = np.lexsort((-w[near], term[near], -rounded, of[near]))
                near, rounded = near[order], rounded[order]
                first = np.flatnonzero(np.diff(of[near], prepend=-1))
                near, rounded = near[first], rounded[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[near], pa.int32()), pa.array(rounded, pa.float64()), terms.take(pa.array(term[near])).cast(pa.string()),
                     pa.array(w[near]), pa.array((w[near] + below[near]) / 2)], ["node", "score", "term", "v", "threshold"])
    return run


def _column_sides(state, splits):
    """(node, docs): numbers of a live node's documents that go right, which have a weight above the threshold."""
    def run(batches):
        node, _ = state.value
        wanted = pa.array([t for _, _, t, _ in splits.value], pa.string())
        for terms, ptr, at, v in _column_batches(batches):
            places = pc.index_in(wanted, terms.cast(pa.string())).to_pylist()
            for (live, s, _, threshold), c in zip(splits.value, places):
                if c is not None:
                    docs = at[ptr[c]:ptr[c + 1]][v[ptr[c]:ptr[c + 1]] > threshold]
                    docs = docs[node[s][docs] == live]
                    yield pa.RecordBatch.from_arrays([pa.array([live], pa.int32()), pa.array([docs.tobytes()], pa.binary())], ["node", "docs"])
    return run


def _column_places(state):
    """Documents of each set with the node that they stand at."""
    def run(batches):
        cur, names, light = state.value
        for batch in batches:
            at, fold = batch.column("at").to_numpy(), batch.column("_f").to_numpy()
            for s, own in enumerate(cur):
                ids, test = own[at], fold == s
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("_f"), batch.column("y").cast(pa.int32()), pa.array(np.full(len(at), s), pa.int32()), pa.array(test),
                     pa.array((~test).astype(np.int64)), pa.array(names, pa.string()).take(pa.array(ids)), pa.array(light[ids])],
                    ["doc_id", "_f", "y", "set", "test", "times", "node", "light"])
    return run


def _grow_by_columns(entries: DataFrame, columns: _Columns, labels: list, n_sets: int, max_depth: int, task_entries: int) -> Trees:
    """The trees of `grow`: large nodes level by level, then all small ones with what is below them."""
    spark, k, n = entries.sparkSession, len(labels), len(columns.y)
    send = spark.sparkContext.broadcast
    docs = send((columns.fold, columns.y))
    cur = np.repeat(np.arange(n_sets, dtype=np.int32)[:, None], n, axis=1)
    names, sets, light, found = [""] * n_sets, list(range(n_sets)), [False] * n_sets, []
    level = list(range(n_sets))
    for depth in range(max_depth + 1):
        whole, load = np.zeros((len(names), k), np.int64), np.zeros(len(names), np.int64)
        for s in range(n_sets):
            train = columns.fold != s
            whole += np.bincount(cur[s][train].astype(np.int64) * k + columns.y[train], minlength=len(names) * k).reshape(-1, k)
            load += np.bincount(cur[s], columns.size, len(names)).astype(np.int64)
        for i in level:
            light[i] = load[i] <= task_entries
        large = [i for i in level if not light[i]]
        live = [i for i in large if (whole[i] > 0).sum() > 1] if depth < max_depth else []
        best = {}
        if live:
            number = np.full(len(names), -1, np.int32)
            number[live] = np.arange(len(live))
            state = send((number[cur], whole[live]))
            rows = columns.rows.mapInArrow(_column_splits(state, docs), "node int, score double, term string, v double, threshold double")
            for r in rows.toArrow().to_pylist():
                rank = (-r["score"], r["term"], -r["v"])
                if r["node"] not in best or rank < best[r["node"]][0]:
                    best[r["node"]] = rank, r
        splits = {live[i]: r for i, (_, r) in best.items()}
        for i in large:
            r = splits.get(i)
            found.append((sets[i], names[i], whole[i].tolist(), *((r["term"], r["threshold"], r["score"]) if r else (None, None, None))))
        level, moved = [], {}
        for i in splits:
            moved[i] = len(names), len(names) + 1
            level += moved[i]
            names += [names[i] + "l", names[i] + "r"]
            sets += [sets[i]] * 2
            light += [False] * 2
        if splits:
            wanted = send([(int(number[i]), sets[i], r["term"], r["threshold"]) for i, r in splits.items()])
            sides = columns.rows.mapInArrow(_column_sides(state, wanted), "node int, docs binary").toArrow().to_pylist()
            to = np.arange(len(names), dtype=np.int32)
            for i, (left, _) in moved.items():
                to[i] = left
            cur = to[cur]
            for side in sides:
                i = live[side["node"]]
                cur[sets[i]][np.frombuffer(side["docs"], "i4")] = moved[i][1]
            wanted.destroy()
        if live:
            state.destroy()
        if not level:
            break
    state = send((cur, names, np.array(light)))
    kind = columns.placed.schema
    schema = f"doc_id {kind['doc_id'].dataType.simpleString()}, _f {kind['_f'].dataType.simpleString()}, y int, set int, test boolean, times bigint, node string, light boolean"
    here = materialize(columns.placed.select("doc_id", "_f", "y", "at").mapInArrow(_column_places(state), schema), key="doc_id")
    nodes = spark.createDataFrame(found, "set int, node string, n array<bigint>, term string, threshold double, score double")
    ended = here.where("NOT light").select("set", "doc_id", "y", "test", "node")
    if any(light):
        below = materialize(_finished(entries, here.where("light"), k, max_depth))
        nodes = nodes.unionByName(below.where("kind = 'node'").select(*nodes.columns))
        ended = ended.unionByName(below.where("kind = 'place'").select(*ended.columns))
    return Trees(nodes, ended, labels, nodes.agg(F.max(F.length("node"))).first()[0] or 0)


def _finished(entries: DataFrame, here: DataFrame, n_classes: int, max_depth: int) -> DataFrame:
    """Nodes (kind `node`) and places of documents (kind `place`) of the whole subtrees below the nodes of `here`."""
    kind, int32, int64 = here.schema["doc_id"].dataType.simpleString(), pa.int32(), pa.int64()
    schema = f"kind string, set int, node string, n array<bigint>, term string, threshold double, score double, doc_id {kind}, y int, test boolean"

    def finish(key: tuple, own: pa.Table, parts: pa.Table) -> pa.Table:
        own = own.append_column("row", pa.array(np.arange(len(own))))
        # An entry per document that it belongs to; a repeated document has its entries as often as a join gives them.
        met = own.select(["doc_id", "_f", "row"]).join(parts.select(["_id", "_ef", "term", "v"]), ["doc_id", "_f"], ["_id", "_ef"], join_type="inner", use_threads=False)
        grown = _Subtrees(own["y"].to_numpy(), own["times"].to_numpy(), met["row"].to_numpy(), met["term"], met["v"].to_numpy(), n_classes)
        found, ends = grown.grow(key[1].as_py(), max_depth)
        at = np.concatenate([rows for _, rows in ends])
        names = pa.array(np.repeat([i for i in range(len(ends))], [len(rows) for _, rows in ends]))
        placed = own.take(pa.array(at))
        none = lambda n, t: pa.nulls(n, t)
        columns = {
            "kind": (["node"] * len(found), ["place"] * len(at)),
            "set": ([key[0].as_py()] * len(found), [key[0].as_py()] * len(at)),
            "node": ([f[0] for f in found], pa.array([name for name, _ in ends], pa.string()).take(names)),
            "n": ([f[1] for f in found], none(len(at), pa.list_(int64))),
            "term": ([f[2] for f in found], none(len(at), pa.string())),
            "threshold": ([f[3] for f in found], none(len(at), pa.float64())),
            "score": ([f[4] for f in found], none(len(at), pa.float64())),
            "doc_id": (none(len(found), placed.schema.field("doc_id").type), placed["doc_id"].combine_chunks()),
            "y": (none(len(found), int32), placed["y"].cast(int32).combine_chunks()),
            "test": (none(len(found), pa.bool_()), placed["test"].combine_chunks())}
        types = {"kind": pa.string(), "set": int32, "node": pa.string(), "n": pa.list_(int64), "term": pa.string(), "threshold": pa.float64(),
                 "score": pa.float64(), "doc_id": placed.schema.field("doc_id").type, "y": int32, "test": pa.bool_()}
        return pa.table({c: pa.chunked_array([pa.array(p, types[c]) if isinstance(p, list) else p for p in both], types[c]) for c, both in columns.items()})

    rows = here.select("set", "node", "doc_id", "_f", F.col("y").cast("int").alias("y"), "test", "times")
    keys = rows.select("set", "node", "doc_id", "_f").distinct()
    parts = keys.join(entries, _same_document()).select(F.col("set").alias("_s"), F.col("node").alias("_n"), "_id", "_ef", F.col("_t").alias("term"), "v")
    return rows.groupBy("set", "node").cogroup(parts.groupBy("_s", "_n")).applyInArrow(finish, schema)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero, judged as decimal numbers, as SQL does."""
    scaled = x * 1e6
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP) * 1_000_000)
    return whole / 1e6


def _purity(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1).astype(float)
    # Repeated entries can outnumber a node's documents, so a side's total may be zero with counts that are not.
    return (counts * counts).sum(axis=-1) / np.where(total == 0, np.nan, total)


class _Subtrees:
    """A node's documents and entries in one task. A document stands at a node a number of times: where it repeats an
    entry of the split term it goes to the sides as often."""

    def __init__(self, y: np.ndarray, times: np.ndarray, row: np.ndarray, term: pa.ChunkedArray, v: np.ndarray, n_classes: int):
        coded = term.combine_chunks().dictionary_encode()
        names = np.array(coded.dictionary.to_pylist(), object)
        place = np.empty(len(names), np.int64)
        place[np.argsort(names)] = np.arange(len(names))
        code = place[coded.indices.to_numpy()]
        order = np.lexsort((-v, code))
        self.names = np.sort(names)
        self.row, self.code, self.v = row[order], code[order], v[order]
        self.share = np.zeros((len(y), n_classes), np.int64)
        self.share[np.arange(len(y)), y] = times
        self.trains = times > 0

    def grow(self, name: str, max_depth: int) -> tuple[list, list]:
        """[(node, n, term, threshold, score)] and [(node, rows that end there)]."""
        found, ends = [], []
        open_nodes = [(name, np.arange(len(self.share)), np.ones(len(self.share), np.int64), np.arange(len(self.row)))]
        slot = np.full(len(self.share), -1)
        while open_nodes:
            node, rows, often, at = open_nodes.pop()
            whole = (self.share[rows] * often[:, None]).sum(axis=0)
            slot[rows] = np.arange(len(rows))
            best = self._best(whole, often[slot[self.row[at]]], at) if (whole > 0).sum() > 1 and len(node) < max_depth else None
            found.append((node, whole.tolist(), *([None] * 3 if best is None else (self.names[best[0]], best[1], best[2]))))
            if best is None:
                ends.append((node, np.repeat(rows, often)))
                continue
            lo, hi = np.searchsorted(self.code[at], best[0], "left"), np.searchsorted(self.code[at], best[0], "right")
            own, right = slot[self.row[at[lo:hi]]], self.v[at[lo:hi]] > best[1]
            ups, downs = (np.bincount(own[side], minlength=len(rows)) for side in (right, ~right))
            downs[ups + downs == 0] = 1
            for side, n in (("l", downs), ("r", ups)):
                inside = n > 0
                open_nodes.append((node + side, rows[inside], (often * n)[inside], at[inside[slot[self.row[at]]]]))
        return found, ends

    def _best(self, whole: np.ndarray, often: np.ndarray, at: np.ndarray) -> tuple | None:
        """(term code, threshold, score) of the split that makes the node purest: the smaller term, then the larger weight on ties."""
        train = self.trains[self.row[at]]
        at, often = at[train], often[train]
        if not len(at):
            return None
        code, v = self.code[at], self.v[at]
        running = np.cumsum(self.share[self.row[at]] * often[:, None], axis=0)
        new_term = np.append(True, code[1:] != code[:-1])
        last = np.flatnonzero(np.append((code[1:] != code[:-1]) | (v[1:] != v[:-1]), True))
        base = np.flatnonzero(new_term)[np.cumsum(new_term)[last] - 1]
        right = running[last] - np.where((base > 0)[:, None], running[base - 1], 0)
        left = whole - right
        below = np.append(v[last[1:]], 0.0)
        below[np.append(code[last[1:]] != code[last[:-1]], True)] = 0.0
        score = _rounded_best(_purity(right) + _purity(left), _purity(whole) + 1e-6)
        if score is None:
            return None
        i, value = score
        return int(code[last[i]]), float((v[last[i]] + below[i]) / 2), float(value)


def _rounded_best(score: np.ndarray, above: float) -> tuple[int, float] | None:
    """First place of the largest rounded score, if it is above the bound; a side without documents has none."""
    score = np.where(np.isnan(score), -np.inf, score)
    near = np.flatnonzero(score >= score.max() - 2e-6)
    if not np.isfinite(score.max()):
        return None
    rounded = _rounded(score[near])
    i = int(np.argmax(rounded))
    return (int(near[i]), rounded[i]) if rounded[i] > above else None


def predict_trees(trees: Trees, n_trees: int = 1) -> DataFrame:
    """(fold, doc_id, y, p): class with the largest summed share over the leaves of a set's trees, the smaller on ties."""
    labels = F.array(*[F.lit(x) for x in trees.labels])
    leaves = broadcast_checked(trees.nodes.where("term IS NULL").select("set", "node", "n"))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x)
    shares = trees.places.where("test").join(leaves, ["set", "node"]) \
        .select(F.floor(F.col("set") / n_trees).cast("int").alias("fold"), "doc_id", "y", F.posexplode(F.transform("n", lambda x: x / total)).alias("c", "share"))
    summed = shares.groupBy("fold", "doc_id", "y", "c").agg(F.round(F.sum("share"), 9).alias("share"))
    best = summed.groupBy("fold", "doc_id", "y").agg(F.min(F.struct((-F.col("share")).alias("s"), "c")).alias("_b"))
    return best.select("fold", "doc_id", F.get(labels, F.col("y")).alias("y"), F.get(labels, F.col("_b.c")).alias("p"))


def classify_tree(weights: DataFrame, docs: DataFrame, n_folds: int, **options) -> DataFrame:
    """(fold, doc_id, y, p) of one tree per training set."""
    return predict_trees(grow(weights, docs, n_folds, **options))


def classify_forest(weights: DataFrame, docs: DataFrame, n_folds: int, n_terms: int, n_trees: int = 100, **options) -> DataFrame:
    """(fold, doc_id, y, p) of `n_trees` bootstrapped trees per training set; a node looks at sqrt(n_terms) terms, about."""
    trees = grow(weights, docs, n_folds, n_trees, subset=min(1.0, n_terms ** -0.5), bootstrap=True, **options)
    return predict_trees(trees, n_trees)
