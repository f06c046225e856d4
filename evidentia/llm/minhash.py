"""MinHash near-duplicates with sequential Bayesian verification and exact confirmation.

Texts with equal shingle sets form a class. Class signatures are banded; classes that share a band's bucket are
candidates. A pair's signatures are compared batch by batch, and the pair is dropped as soon as the posterior probability
that its similarity reaches the threshold falls below MISS. Survivors are confirmed on their full shingle sets, which are
read from the texts again for the classes concerned only.

A bucket never emits all its pairs. First each of its members is paired with its smallest one, then, where that leaves it
unconnected, with its most central one, which shares the most buckets. Buckets whose members the links found so far don't
connect are finished together: those with the same largest component form a group, and every
member outside that component is compared with all members of the group. A group of m members of which l are outside is
dealt into some 256 blocks of sqrt(l m) / 16 by as many members, so it costs 32 sqrt(l m) rows; no block has more than
MAX_SIDE by MAX_SIDE members, and a task holds the sets of one side of one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Table, join_checked, ship, write
from .textarrays import mix, shingles

#: 32 bands of 4 rows: a pair of similarity 0.8 shares no bucket with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Signature positions compared at a time, and the posterior probability below which a pair is dropped.
BATCH, MISS = 16, 1e-5
#: Parts into which the pairs of one leader are dealt.
SALTS = 64
#: Members on one side of a block: at least, at most, and the number of blocks on a side of a group.
MIN_SIDE, MAX_SIDE, SIDES = 8, 1024, 16
_HASHES = BANDS * ROWS
_A = mix(np.arange(1, _HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, 1001 + _HASHES, dtype=np.uint64))


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set, as uint32."""
    low = np.full(_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(low, (s[i : i + 2048, None] * _A + _B).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(positions compared, matches below which a pair is dropped) for each batch.

    With a uniform prior, the similarity after m matches in n positions is distributed as Beta(m + 1, n - m + 1), and it
    reaches t with the probability that a binomial variable of n + 1 trials and chance t is m at most.
    """
    t, found = percent / 100, []
    for n in range(BATCH, _HASHES + 1, BATCH):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        found.append((n, m))
    return found


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, h1, h2, sig) for each row (id, text): size and 128-bit hash of the set, and its signature (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 2000):
                rows = batch.slice(part, 2000)
                n, h1, h2, sig = [], [], [], []
                for text in rows.column("text"):
                    s = shingles(text.as_py() or "", words)
                    n.append(len(s))
                    h1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    sig.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "h1", "h2", "sig"])
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, sig binary")


def _likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures doesn't rule out."""
    limits = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, _HASHES) for c in ("x", "y"))
            left = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for n, least in limits:
                matches[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(1)
                left = left[matches[left] >= least]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(left)), batch.column("b").take(pa.array(left))], ["a", "b"])

    both = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> Table:
    """(id, s): the shingle sets of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                rows = batch.slice(part, 1000)
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array([shingles(t.as_py() or "", words).tobytes() for t in rows.column("text")], pa.binary())], ["id", "s"])

    wanted = join_checked(docs, ids, ["id"], "left_semi", ids.count())
    return write(wanted.mapInArrow(run, "id long, s binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> Table:
    """The pairs (a, b) whose full sets have a similarity of percent / 100 at least.

    The pairs of each a are dealt into parts; a part gets the set of a first and then those of its b, one after another,
    so that a task holds one set at a time and the set of a popular a is sent once for each part.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    first = dealt.select("a", "part").distinct().join(sets.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "s")
    rest = dealt.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaders = None, []
        for batch in batches:
            found = []
            for a, part, b, s in zip(*(batch.column(c) for c in ("a", "part", "b", "s")), strict=True):
                key = (a.as_py(), part.as_py())
                if key != now:
                    now, leaders = key, []
                values = np.frombuffer(s.as_buffer(), np.uint64)
                if not b.is_valid:
                    leaders.append(values.copy())
                    continue
                for other in leaders:
                    small, large = sorted((values, other), key=len)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    same = int((large[at] == small).sum())
                    if 100 * same >= percent * (len(values) + len(other) - same):
                        found.append((key[0], b.as_py()))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    rows = first.unionAll(rest).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return write(rows.mapInArrow(compare, "a long, b long").distinct(), "links")


def _verified(pairs: Table, sigs: DataFrame, docs: DataFrame, words: int, percent: int) -> Table:
    """The pairs (a, b) that pass the sequential comparison and then that of full sets; drops pairs."""
    likely = write(_likely(pairs.df, sigs, percent), "likely")
    pairs.drop()
    ids = write(likely.df.select(F.col("a").alias("id")).unionAll(likely.df.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = _sets(ids.df, docs, words)
    links = _confirmed(likely.df, sets.df, percent)
    for t in (likely, ids, sets):
        t.drop()
    return links


def _open(members: DataFrame, joined: DataFrame) -> Table:
    """(key, rep, label): the members (key, rep) of buckets that hold more than one component, with their components."""
    named = write(members.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label")), "named")
    keys = write(named.df.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key"), "open")
    left = write(named.df.join(keys.df, "key"), "left")
    named.drop()
    keys.drop()
    return left


def _central_pairs(left: DataFrame) -> Table:
    """(a, b): each member of a bucket with the bucket's most central one, if they are in different components."""
    sizes = write(left.groupBy("key").agg(F.count("*").alias("n")), "sizes")
    totals = left.join(sizes.df, "key").groupBy("rep", "label").agg(F.sum("n").alias("score"), F.collect_list("key").alias("keys"))  # BANDS keys at most
    scored = write(totals.select(F.explode("keys").alias("key"), "rep", "label", "score"), "scored")
    central = write(scored.df.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("r"), "label")).alias("x")).select("key", (-F.col("x.r")).alias("c"), F.col("x.label").alias("of")), "central")
    pairs = write(scored.df.join(central.df, "key").filter("label <> of").select(F.least("c", "rep").alias("a"), F.greatest("c", "rep").alias("b")).distinct(), "pairs")
    for t in (sizes, scored, central):
        t.drop()
    return pairs


def _groups(left: DataFrame) -> DataFrame:
    """(of, rep, label, lead) from the buckets (key, rep, label) that aren't connected: groups by largest component.

    lead marks the members outside the group's largest component.
    """
    sizes = write(left.select("rep", "label").distinct().groupBy("label").agg(F.count("*").alias("size")), "sizes")
    sized = write(left.join(sizes.df, "label"), "sized")
    largest = write(sized.df.groupBy("key").agg(F.max(F.struct(F.col("size"), (-F.col("label")).alias("l"))).alias("x")).select("key", (-F.col("x.l")).alias("of")), "largest")
    return sized.df.join(largest.df, "key").select("of", "rep", "label", (F.col("label") != F.col("of")).alias("lead")).distinct()


def _crossing(groups: DataFrame, sets: DataFrame, sigs: DataFrame, percent: int) -> Table:
    """Links (a, b) between members of a group that are in different components: of a member, one for each component and block."""
    sizes = groups.groupBy("of").agg(F.count("*").alias("m"), F.count_if("lead").alias("l"))
    side = F.greatest(F.lit(MIN_SIDE), F.least(F.lit(MAX_SIDE), F.ceil(F.sqrt(F.col("l") * F.col("m")) / SIDES)))
    plan = write(sizes.select("of", F.ceil(F.col("m") / side).cast("int").alias("p"), F.ceil(F.col("l") / side).cast("int").alias("q")), "blocks")
    dealt = groups.join(plan.df, "of")
    own_p, own_q = F.pmod(F.xxhash64("rep"), F.col("p")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("q")).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt.select("of", own_p.alias("i"), upto("q").alias("j"), F.lit(True).alias("member"), "rep", "label")
    leaders = dealt.filter("lead").select("of", upto("p").alias("i"), own_q.alias("j"), F.lit(False).alias("member"), "rep", "label")
    limits = least_matches(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, reps, labels, sig, values, owner, known = None, False, [], [], [], [], None, set()
        for batch in batches:
            found = []
            for of, i, j, member, rep, label, g, s in zip(*(batch.column(c) for c in ("of", "i", "j", "member", "rep", "label", "sig", "s")), strict=True):
                key = (of.as_py(), i.as_py(), j.as_py())
                if key != now:
                    now, ready, reps, labels, sig, values, known = key, False, [], [], [], [], set()
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(g.as_buffer(), "<u4")
                if not member.as_py():
                    reps.append(rep.as_py())
                    labels.append(label.as_py())
                    values.append(x.copy())
                    sig.append(y.copy())
                    continue
                if not reps:
                    continue
                if not ready:
                    ready, labels, sig = True, np.array(labels), np.array(sig)
                of_x = label.as_py()
                left = np.flatnonzero(labels != of_x)
                matches = np.zeros(len(labels), np.int64)
                for n, least in limits:
                    matches[left] += (sig[left, n - BATCH : n] == y[n - BATCH : n]).sum(1)
                    left = left[matches[left] >= least]
                left = [k for k in left.tolist() if (k, of_x) not in known]
                if not left:
                    continue
                both = np.concatenate([values[k] for k in left])
                at = np.searchsorted(x, both)
                at[at == len(x)] = 0
                ends = np.cumsum([len(values[k]) for k in left])
                same = np.diff(np.concatenate(([0], np.cumsum(x[at] == both)[ends - 1])))
                for k, c in zip(left, same.tolist(), strict=True):
                    if 100 * c >= percent * (len(x) + len(values[k]) - c):
                        known.add((k, of_x))
                        found.append((reps[k], rep.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    both = members.unionAll(leaders).join(sets.withColumnRenamed("id", "rep").join(sigs, "rep"), "rep")
    rows = both.select("of", "i", "j", "member", "rep", "label", "sig", "s").repartition("of", "i", "j").sortWithinPartitions("of", "i", "j", "member")
    result = write(rows.mapInArrow(compare, "a long, b long"), "links")
    plan.drop()
    return result


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; the id column keeps its name and becomes a long.

    A set has the distinct runs of ``words`` words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) of the whole text; with
    fewer words, the whole sequence as one. Null texts and texts without words have an empty set and link with nothing.
    Rows link if 100 * intersection >= percent * union. component_id is the smallest id reachable by links, itself
    included; kept says that this is the row's own id. Repeated rows are judged one by one: each gets its component, and a
    repeated id that leads its component is kept each time. Rows with a null id link with nothing and aren't kept. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = write(_signatures(source, words), "signatures")
    classes = write(signed.df.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")), "classes")
    sigs = classes.df.select("rep", "sig")
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)) for i in range(BANDS)])
    keys = sigs.select("rep", F.explode(bands).alias("key"))
    buckets = write(keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).filter("n > 1 and a <> b"), "buckets")
    more = buckets.df.filter("n > 2").select("key", "a")
    active = write(keys.join(more, "key").filter("rep <> a").select("key", "a", "rep"), "bucketed")
    pairs = write(buckets.df.filter("n = 2").select("a", "b").unionAll(active.df.select("a", F.col("rep").alias("b"))).distinct(), "pairs")
    buckets.drop()
    links = _verified(pairs, sigs, source, words, percent)
    joined = components(links.df)
    everyone = active.df.select("key", "rep").unionAll(active.df.select("key", F.col("a").alias("rep")).distinct())
    left = _open(everyone, joined.df)
    active.drop()
    found = [links]
    if left.df.limit(1).count():
        found.append(_verified(_central_pairs(left.df), sigs, source, words, percent))
        joined.drop()
        joined = components(links.df.unionAll(found[1].df))
        still = _open(left.df.select("key", "rep"), joined.df)
        left.drop()
        left = still
    if left.df.limit(1).count():
        groups = write(_groups(left.df), "groups")
        ids = write(groups.df.select(F.col("rep").alias("id")).distinct(), "ids")
        sets = _sets(ids.df, source, words)
        found.append(_crossing(groups.df, sets.df, sigs, percent))
        for t in (groups, ids, sets, joined):
            t.drop()
        joined = components(reduce(DataFrame.unionAll, [t.df for t in found]))
    for t in (left, *found):
        t.drop()
    named = signed.df.select("id", "n", "h1", "h2").join(classes.df.select("h1", "h2", F.col("n").alias("m"), "rep"), ["h1", "h2"], "left").filter("m is null or m = n")
    out = named.join(joined.df.withColumnRenamed("id", "rep"), "rep", "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
