"""Near-duplicate documents by an inverted join on MinHash signature coordinates.

1. Every text becomes its set of 5-word shingles and a signature of COORDS minima. Equal sets are one class.
2. Each class is posted under its coordinate-value pairs. Pairs in the global order of their counts, a signature needs
   to be posted under its COORDS - MATCHES + 1 rarest pairs only: two signatures that agree in MATCHES coordinates meet
   there (the prefix), and a class whose values nobody else has that often is skipped altogether.
3. Within a posting list collisions are counted over whole signatures. Classes that are linked already needn't be
   compared with each other (skip merging): a list yields a spanning forest, not all of its pairs.
4. The full sets of each candidate group are compared exactly, again as a spanning forest.

Long posting lists and large candidate groups are dealt into blocks. A few leaders are compared with all of a group's
rows first; then only rows outside the largest component that this makes go to every block and are compared with all.
Near copies of one page thus cost rows in proportion to their number. What stays quadratic, in blocks, are rows that
meet in a hot list or group without being linked to most of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, bounded_broadcast, connected_components, cut, fixed_rows, mix, seeds, sized_partitions, small_batches, span_hashes, table, text_slices, word_spans

WORDS = 5
COORDS = 64
#: Collisions that make a candidate. At a similarity of 0.85, 64 coordinates collide 54.4 times on average, with a
#: standard deviation of 2.9: a pair at the very threshold is missed about once in 400,000 times.
MATCHES = 40
#: Rows of a posting list, and rows and shingles of a candidate group, that a task's block may have.
LIST_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 4096, 1024, 1_000_000
#: About so many rows lead a group of several blocks.
LEADERS = 48

_ORDER = seeds(WORDS, 301) | np.uint64(1)
_COORD = seeds(COORDS, 302) | np.uint64(1)
_COORD_ID = seeds(COORDS, 303)


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each document, ascending, and their offsets by document."""
    starts, ends, doc = word_spans(buf, offs)
    h = span_hashes(buf, starts, ends, folded=True)
    docs = len(offs) - 1
    words = np.bincount(doc, minlength=docs)
    first = np.concatenate(([0], np.cumsum(words)))
    n = max(0, len(h) - WORDS + 1)
    s = np.zeros(n, np.uint64)
    for j in range(WORDS):
        s += h[j : j + n] * _ORDER[j]
    s = mix(s)
    out, sizes = [], np.zeros(docs, np.int64)
    for d in range(docs):
        if words[d] >= WORDS:
            own = np.sort(s[first[d] : first[d + 1] - WORDS + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif words[d]:
            own = mix(np.array([(h[first[d] : first[d + 1]] * _ORDER[: words[d]]).sum(dtype=np.uint64) + np.uint64(words[d])]))
        else:
            continue
        out.append(own)
        sizes[d] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, tokens, low): the set's size and hash, its coordinate-value pairs as numbers, and
    their lowest bytes. An empty set has no tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            size, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            tokens = np.zeros((n, COORDS), np.uint64)
            for i, j, buf, offs in text_slices(b.column(1)):
                flat, at = shingle_sets(buf, offs)
                size[i:j] = np.diff(at)
                some = np.flatnonzero(size[i:j])
                if not len(some):
                    continue
                heads = at[some]
                h1[i + some] = np.add.reduceat(mix(flat ^ _COORD_ID[0]), heads)
                h2[i + some] = np.bitwise_xor.reduceat(mix(flat ^ _COORD_ID[1]), heads)
                for k in range(COORDS):
                    tokens[i + some, k] = mix(np.minimum.reduceat(flat * _COORD[k], heads) ^ _COORD_ID[k])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, COORDS, 0)))).astype(np.int32)), pa.array(tokens[size > 0].view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, binary_column(tokens.astype(np.uint8))], names=["doc_id", "n_shingles", "h1", "h2", "tokens", "low"])

    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return frame.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, tokens array<long>, low binary")


def spanning(n: int, hits: Callable[[int], np.ndarray], leaders: int = 32) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``hits(i)`` are the neighbours of i. Whoever isn't queried is in
    one component in the end, so no edge between two components is missed."""
    label, asked, edges = np.arange(n), np.zeros(n, bool), []

    def ask(i: int) -> None:
        asked[i] = True
        found = hits(i)
        for j in found[label[found] != label[i]]:
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]

    for i in range(n):
        if leaders == 0 or 2 * np.bincount(label, minlength=n).max() > n:
            break
        if label[i] == i and not asked[i]:
            ask(i)
            leaders -= 1
    main = int(np.bincount(label, minlength=n).argmax())
    member = int(np.flatnonzero(label == main)[0])
    for i in range(n):
        if not asked[i] and label[i] != label[member]:
            ask(i)
    return edges


def whole_groups(batches: Iterator[pa.RecordBatch], at: int, rows: int = 16384) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or more that end where the value of column ``at`` changes."""
    held: list[pa.RecordBatch] = []
    count, least = 0, rows
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held)
        key = t.column(at).to_numpy()
        end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if end:
            yield t.slice(0, end)
        held, count = t.slice(end).to_batches(), t.num_rows - end
        rows = max(least, 2 * count)  # a long group isn't gone over again with every batch
    if held:
        yield pa.Table.from_batches(held)


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def asked(n: int, askers: np.ndarray, hits: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between ``askers`` and all others."""
    label, edges = np.arange(n), []
    for i in askers.tolist():
        found = hits(i)
        for j in found[label[found] != label[i]]:
            if label[j] != label[i]:
                edges.append((i, int(j)))
                label[label == label[j]] = label[i]
    return edges


def _alike(low: np.ndarray, size: np.ndarray, other_low: np.ndarray, other_size: np.ndarray) -> np.ndarray:
    """Whether signatures collide often enough, and the sets' sizes let them be similar."""
    return ((low == other_low).sum(1) >= MATCHES) & (100 * np.minimum(size, other_size) >= 85 * np.maximum(size, other_size))


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, 0):
        task, rep, role, size = (t.column(i).to_numpy() for i in range(4))
        low = fixed_rows(t.column(4).combine_chunks(), np.uint8, COORDS)
        heads = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        sizes = np.diff(np.append(heads, len(task)))
        group = np.repeat(np.arange(len(heads)), sizes)
        leads = np.add.reduceat(role, heads) > 0
        a, b = [], []
        short = np.repeat((sizes <= 8) & ~leads, sizes)
        for d in range(1, 8):
            i = np.flatnonzero(short[:-d] & (group[:-d] == group[d:]))
            i = i[_alike(low[i], size[i], low[i + d], size[i + d])]
            a.append(rep[i])
            b.append(rep[i + d])
        for g in np.flatnonzero((sizes > 8) | leads):
            own = slice(heads[g], heads[g] + sizes[g])
            s, n, r = low[own], size[own], rep[own]
            found = _forest(role[own], lambda q, s=s, n=n: np.flatnonzero(_alike(s, n, s[q], n[q])))
            if found:
                i, j = np.array(found).T
                a.append(r[i])
                b.append(r[j])
        yield _edges(a, b)


def _forest(role: np.ndarray, hits: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    askers = np.flatnonzero(role)
    return asked(len(role), askers, hits) if len(askers) else spanning(len(role), hits)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (task, node, ...) with every task's rows together."""
    return rows.repartition(sized_partitions(rows.sparkSession), "task").sortWithinPartitions("task", "node")


def hot_links(rows: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that span what is linked within the groups of ``rows`` (group, node, blocks, lead, ...), each of
    ``blocks`` blocks. ``find`` has links of (task, node, role, ...): of rows of role 1 with all others of their task, or of
    all with all if there are none.

    First the leaders, picked by a hash with probability ``lead``, meet every block. Of two linked rows that aren't both
    in the largest component now, one is outside: so these rows go to every block then, in blocks of their own.
    """
    more = [c for c in rows.columns if c not in ("group", "node", "blocks", "lead")]
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    leaders = rows.filter(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 30)) / float(1 << 30) < F.col("lead"))
    led = bounded_broadcast(cut(leaders.select("group").distinct()))
    first = rows.join(led, "group", "left_semi").select(F.xxhash64("group", mine).alias("task"), "node", F.lit(0).alias("role"), *more)
    guests = leaders.withColumn("block", every).select(F.xxhash64("group", "block").alias("task"), "node", F.lit(1).alias("role"), *more)
    first = cut(find(first.unionByName(guests)).distinct())
    placed = cut(rows.select("group", "node", "blocks").join(connected_components(first), "node", "left"))
    sizes = placed.groupBy("group", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max_by("component", F.when(F.col("component").isNotNull(), F.col("n"))).alias("main"), F.sum("n").alias("n"))
    rest = placed.join(bounded_broadcast(cut(main)), "group").filter("main is null or component is null or component <> main")
    rest = cut(rest.select("group", "node", "blocks", "n"))
    if rest.isEmpty():
        return first
    turns = rest.groupBy("group").agg(F.ceil(F.first("blocks") * F.count("*") / F.first("n")).cast("int").alias("turns"))
    turns = bounded_broadcast(cut(turns))
    turn = F.pmod(F.xxhash64("node", F.lit(8)), F.col("turns")).cast("int")
    again = rows.join(turns, "group").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    again = again.select(F.xxhash64("group", mine, "turn").alias("task"), "node", F.lit(0).alias("role"), *more)
    askers = rows.join(rest.select("group", "node"), ["group", "node"], "left_semi").join(turns, "group").withColumn("block", every)
    askers = askers.select(F.xxhash64("group", "block", turn).alias("task"), "node", F.lit(1).alias("role"), *more)
    return first.unionByName(find(again.unionByName(askers)))


def candidate_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) that span all classes (rep, n_shingles, tokens, low) whose signatures collide often enough."""
    keep = COORDS - MATCHES + 1
    postings = classes.select("rep", F.explode("tokens").alias("token"))
    # counted by sums of tasks; hot tokens are few, so their counts go to where the postings are
    counts = cut(postings.groupBy("token").agg(F.count("*").alias("cnt")).filter("cnt > 1"))
    hot = cut(counts.filter(F.col("cnt") > LIST_BLOCK))
    some_hot = not hot.isEmpty()
    if some_hot:
        hot = bounded_broadcast(hot)
        shared = postings.join(hot, "token", "left_anti").join(counts, "token").unionByName(postings.join(hot, "token"))
    else:
        shared = postings.join(counts, "token")
    # a class has COORDS tokens, so this list is short; the tokens that it has alone come first in the order
    ranked = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("cnt", "token"))).alias("own")).filter(F.size("own") >= MATCHES)
    prefix = ranked.withColumn("own", F.slice("own", 1, F.lit(keep) - (F.lit(COORDS) - F.size("own"))))
    if some_hot:
        prefix = cut(prefix)  # hot and other lists are taken from it
    rows = prefix.join(classes.select("rep", "n_shingles", "low"), "rep").select(F.col("rep").alias("node"), F.col("n_shingles").alias("size"), "low", F.explode("own").alias("p"))
    rows = rows.select(F.col("p.token").alias("group"), "node", "size", "low", F.ceil(F.col("p.cnt") / LIST_BLOCK).cast("int").alias("blocks"), (LEADERS / F.col("p.cnt")).alias("lead"))
    few = rows.filter("blocks = 1").select(F.col("group").alias("task"), "node", F.lit(0).alias("role"), "size", "low")
    links = _by_signatures(few)
    if some_hot:
        links = links.unionByName(hot_links(cut(rows.filter("blocks > 1")), _by_signatures))
    return links.distinct()


def _by_signatures(rows: DataFrame) -> DataFrame:
    return dealt(rows.select("task", "node", "role", "size", "low")).mapInArrow(_list_links, "a long, b long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(task, node, role, set): the hashes of the shingles."""
    for b in batches:
        sets: list[bytes] = []
        for _, _, buf, offs in text_slices(b.column(3)):
            flat, at = shingle_sets(buf, offs)
            sets += [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary())], names=["task", "node", "role", "shingles"])


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, 0, 256):
        task, ids, role = (t.column(i).to_numpy() for i in range(3))
        sets = t.column(3).to_pylist()
        heads = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        a, b = [], []
        for x, y in zip(heads, np.append(heads[1:], len(task)), strict=True):
            if y - x < 2:
                continue
            size = np.array([len(s) // 8 for s in sets[x:y]])
            values, flat = np.unique(np.frombuffer(b"".join(sets[x:y]), np.uint64), return_inverse=True)
            at = np.cumsum(size) - size
            mark = np.zeros(len(values), bool)

            def linked(q: int, size=size, flat=flat, at=at, mark=mark) -> np.ndarray:
                own = flat[at[q] : at[q] + size[q]]
                mark[own] = True
                both = np.add.reduceat(mark[flat], at, dtype=np.int64)
                mark[own] = False
                return np.flatnonzero(100 * both >= 85 * (size + size[q] - both))

            found = _forest(role[x:y], linked)
            if found:
                i, j = np.array(found).T
                a.append(ids[x:y][i])
                b.append(ids[x:y][j])
        yield _edges(a, b)


def confirmed_links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) that span what is truly linked within each group (node, component, n_shingles) of documents, by their
    full sets."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string"))

    def by_sets(rows: DataFrame) -> DataFrame:
        # a document may be wanted by several tasks, and its text is read where it lies if these are few
        wanted = bounded_broadcast(cut(rows.select("task", "node", "role")))
        packed = texts.join(wanted, "node").select("task", "node", "role", "text").mapInArrow(_packed, "task long, node long, role int, shingles binary")
        return dealt(packed).mapInArrow(_group_links, "a long, b long")

    sizes = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.ceil(F.greatest(F.col("n") / GROUP_BLOCK, F.col("w") / GROUP_SHINGLES)).cast("int")
    lead = F.least(LEADERS / F.col("n"), 0.5 * GROUP_SHINGLES / F.col("w"))
    sizes = bounded_broadcast(cut(sizes.select("component", blocks.alias("blocks"), lead.alias("lead"))))
    rows = cut(groups.join(sizes, "component").select(F.col("component").alias("group"), "node", "blocks", "lead"))
    links = by_sets(rows.filter("blocks = 1").select(F.col("group").alias("task"), "node", F.lit(0).alias("role")))
    large = rows.filter("blocks > 1")
    return links if large.isEmpty() else links.unionByName(hot_links(large, by_sets))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Documents are linked if 100 * intersection >= 85 * union of their shingle sets. Null texts and texts without words
    have an empty set and stand alone; with fewer than 5 words, the whole sequence is the one shingle. Very long texts
    count with all their shingles. Rows that share a doc_id are one node. A null doc_id stands alone: its component is
    null, and it is kept. Empty tables give no rows.
    """
    sets = cut(signed(docs))
    real = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.first("low").alias("low")))
    groups = connected_components(candidate_links(classes))
    names = classes.select("h1", "h2", "n_shingles", "rep")
    groups = cut(groups.join(names.select(F.col("rep").alias("node"), "n_shingles"), "node"))
    parts = connected_components(confirmed_links(docs, groups).unionByName(_same_id(real)))
    named = names.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    found = sets.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(real: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id (none in a table with unique ids)."""
    twice = real.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    names = real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    return real.join(twice, "doc_id").join(names, ["h1", "h2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
