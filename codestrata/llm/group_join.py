"""N-gram Jaccard join over a token-group matrix: near-duplicate classes of whole documents, without losing a link."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import BROADCAST_ROWS, lookup, packed, row_key, unpacked
from .shingles import LEAST, least_common, min_bands, mix, parity_bits, sets_of, shingles_of, signatures

#: Shared prefix tokens that a pair must have for each part of its smaller set (fewer for tiny sets), and leader keys per document.
OVERLAP, BANDS = 3, 8
#: Longs of a parity sketch, and the least elements of a part (on average) once a set is dealt out to several.
LONGS, PART = 8, 256
#: Frequent shingles that go last in the order of tokens. The list only sets the order, so any bound keeps results whole.
FREQUENT = 100_000
_CHUNK, _OFTEN = 1_000_000, 3
#: Rows and bytes of text that are worked on at once, and signatures of recent documents that a task keeps.
_ROWS, _BYTES, _SEEN = 256, 1 << 18, 100_000
#: Rounds in which sets look for neighbours outside their group, leaders per key and round, and neighbours tried.
ROUNDS, LEADERS, NEAREST = 1, 4, 3
#: Members of a block of a group on average, and tokens counted at a time when blocks are compared.
_MEMBERS, _COLUMNS = 128, 4096


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in order, at most ``_ROWS`` and, unless a single text is longer, ``_BYTES`` of text at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        full = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _BYTES, side="right"))
        stop = min(start + _ROWS, max(full, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def _local_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles seen at least three times within two million; rarer ones cannot be among the frequent."""

    def flush(held):
        u, c = np.unique(np.concatenate(held), return_counts=True)
        often = c >= _OFTEN
        return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["token", "seen"])

    held, size = [], 0
    for batch in batches:
        for piece in _pieces(batch):
            h, _ = shingles_of(piece.column("text").to_pylist())
            held.append(h)
            size += len(h)
            if size >= _CHUNK:
                yield flush(held)
                held, size = [], 0
    if held:
        yield flush(held)


def frequent_tokens(docs: DataFrame, bound: int = FREQUENT) -> np.ndarray:
    """The ``bound`` most frequent shingles of all documents by rising count, at most 16 bytes each: a fixed size."""
    counted = docs.select("text").mapInArrow(_local_counts, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen"))
    top = counted.orderBy(F.col("seen").desc(), "token").limit(bound).toArrow()
    return top.column("token").to_numpy()[::-1].view(np.uint64) if len(top) else np.empty(0, np.uint64)


def _level_of(n: np.ndarray) -> np.ndarray:
    """The level at which sets of ``n`` elements have their own parts: there are two to its power."""
    return np.maximum(np.frexp((n // PART).astype(np.float64))[1] - 1, 0)


def _prefix(tokens: np.ndarray, late: np.ndarray, keep: int) -> np.ndarray:
    """The first ``keep`` tokens of a part: those not in the list of frequent ones by value, then the others by rank."""
    if late.any():
        rare = late == 0
        others = tokens[~rare][np.argsort(late[~rare])]
        tokens = tokens[rare]
        if len(tokens) < keep:
            return np.concatenate([tokens, others[: keep - len(tokens)]])
    return np.partition(tokens, keep - 1)[:keep]


def set_parts(s: np.ndarray, ends: np.ndarray, late: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The parts of sets under which they look for similar sets: set, part, size, bits (parity sketch), prefix (first tokens).

    A set of up to 511 elements is one part; larger ones are dealt out by hash to parts of 256 to 511 elements on
    average. If two sets link, then in some part they are as similar as they must be as a whole (the differences of all
    parts add up to that of the sets, and so do the sizes), so the sketches of parts may be compared. Both sets need the
    same number of parts: that of the larger one, so a set also comes with the number that a set a third larger would have.

    Part 0 is the whole set, whatever its size. It alone has the prefix, so that each token is listed once: as many first
    tokens as the set may lack in one that links, and ``OVERLAP`` more for each of its own parts. Of the tokens that two
    linked sets share, these many come first in both.

    The sets are not empty and lie in ``s`` one after the other; ``late`` has the ranks of frequent elements, else 0.
    """
    n = np.diff(ends)
    low, high = _level_of(n), _level_of(n * 100 // LEAST)
    owners, parts, sizes, bits, prefixes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty((0, LONGS), np.int64)], []
    for level in np.unique(np.concatenate([low * 0, low, high])).tolist():
        there = (low == level) | (high == level) | (level == 0)
        at = np.flatnonzero(np.repeat(there, n))
        own = (mix(s[at] ^ np.uint64(0x3C79AC492BA7B653)) & np.uint64((1 << level) - 1)).view(np.int64)
        key = np.repeat(np.flatnonzero(there) << level, n[there]) + own
        by_part = np.argsort(key, kind="stable") if level else slice(None)
        at, key = at[by_part], key[by_part]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        tokens, rank, first = mix(s[at] + np.uint64(level)), late[at], key[bounds[:-1]]
        owners.append(first >> level)
        parts.append((level << 40) + (first & ((1 << level) - 1)))
        sizes.append(np.diff(bounds))
        bits.append(parity_bits(tokens, bounds, LONGS))
        if level:
            prefixes += [np.empty(0, np.int64)] * len(first)
            continue
        for a, b, own_level in zip(bounds[:-1].tolist(), bounds[1:].tolist(), low.tolist(), strict=True):
            need = least_common(b - a)
            prefixes.append(_prefix(tokens[a:b], rank[a:b], b - a - need + min(OVERLAP << own_level, need)).view(np.int64))
    owner = np.concatenate(owners)
    by_set = np.argsort(owner, kind="stable")
    return owner[by_set], np.concatenate(parts)[by_set], np.concatenate(sizes)[by_set], np.concatenate(bits)[by_set], [prefixes[i] for i in by_set.tolist()]


_PARTS = "array<struct<part:long,size:long,bits:array<long>,prefix:array<long>>>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    """Array of lists of longs."""
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(flat))


def _spaced(size: np.ndarray, there: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Array of lists of ``size`` ``values`` each where ``there`` is true, and null elsewhere."""
    ends = np.zeros(len(there) + 1, np.int64)
    ends[1:][there] = size
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), values, mask=pa.array(~there))


def _features(frequent: np.ndarray):
    by_value = np.argsort(frequent)
    known, rank = frequent[by_value], by_value + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        maybe = np.zeros(1 << 20, bool)  # by the first 20 bits, as few shingles are frequent
        maybe[(known >> np.uint64(44)).view(np.int64)] = True

        def late_of(s: np.ndarray) -> np.ndarray:
            late = np.zeros(len(s), np.int64)
            tried = np.flatnonzero(maybe[(s >> np.uint64(44)).view(np.int64)])
            if len(tried):
                at = np.minimum(np.searchsorted(known, s[tried]), len(known) - 1)
                late[tried] = np.where(known[at] == s[tried], rank[at], 0)
            return late

        for whole in batches:
            for batch in _pieces(whole):
                s, ends = sets_of(batch.column("text").to_pylist())
                n = np.diff(ends)
                sigs, fresh = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
                sigs[n > 0] = signatures(s, np.unique(ends))
                for d in np.flatnonzero(n).tolist():
                    sig = int(sigs[d])
                    fresh[d] = sig not in seen  # a recent copy needs no tokens of its own
                    seen.add(sig)
                if len(seen) > _SEEN:
                    seen.clear()
                s, ends = s[np.repeat(fresh, n)], np.cumsum([0, *n[fresh]])
                owner, part, size, bits, prefix = set_parts(s, ends, late_of(s))
                parts = pa.StructArray.from_arrays(
                    [pa.array(part), pa.array(size), _lists(list(bits)), _lists(prefix)], ["part", "size", "bits", "prefix"]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("rk"),
                        pa.array(sigs, mask=n == 0),
                        pa.array(n),
                        _spaced(LONGS, fresh, pa.array(parity_bits(s, ends, LONGS).ravel())),
                        _spaced(BANDS, fresh, pa.array(min_bands(s, ends, BANDS).ravel())),
                        _spaced(np.bincount(owner, minlength=int(fresh.sum())), fresh, parts),
                    ],
                    ["doc_id", "rk", "sig", "n", "bits", "bands", "parts"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in _pieces(whole):
            s, ends = sets_of(batch.column("text").to_pylist())
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("sig"), tokens], ["sig", "tokens"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): v, root (smallest member), for every v that has a link.

    Each round hangs every node on its smallest neighbour, shortens the chains to their roots by doubling and contracts
    the links, until no link is left between different roots; tables are written between rounds, none is collected.
    """
    live, known = cut(edges.where("a <> b").select("a", "b").distinct()), None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
        while True:
            up = tree.select(F.col("v").alias("_v"), F.col("root").alias("_up"))
            jumped = cut(tree.join(up, F.col("root") == F.col("_v")).select("v", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")))
            tree = jumped.select("v", "root")
            if jumped.where("moved").isEmpty():
                break
        to = tree.select(F.col("v").alias("_v"), F.col("root").alias("_r"))
        known = tree if known is None else cut(known.join(to, F.col("root") == F.col("_v"), "left").select("v", F.coalesce("_r", "root").alias("root")))
        a = live.join(to, F.col("a") == F.col("_v")).select(F.col("_r").alias("a"), "b")
        live = cut(a.join(to, F.col("b") == F.col("_v")).select("a", F.col("_r").alias("b")).where("a <> b").distinct())
    if known is None:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("root")).limit(0)
    return known


def _sets_of(docs: DataFrame, needed: DataFrame, bound: int, held: list[DataFrame]) -> DataFrame:
    """sig, tokens of the classes ``needed`` (sig, rk). Tables of ``held`` have no set in common; what they lack is derived and added."""
    n_needed = needed.count()
    missing = needed.select("sig", "rk")
    for table in held:
        missing = missing.join(table.select("sig"), "sig", "left_anti")
    missing = cut(missing) if held else missing
    n_missing = missing.count() if held else n_needed
    if n_missing:
        # one row per class is fetched by its content key; texts are shuffled only if the list of keys passes the bound
        texts = docs.select("text", row_key().alias("rk")).join(lookup(missing, n_missing, bound), "rk").select("sig", "text")
        held.append(cut(texts.mapInArrow(_sets, "sig long, tokens array<long>").dropDuplicates(["sig"])))
    if not held:
        return docs.sparkSession.createDataFrame([], "sig long, tokens array<long>")
    return reduce(DataFrame.unionByName, held).join(lookup(needed.select("sig"), n_needed, bound), "sig", "left_semi")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, bound: int, held: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of signatures whose whole sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    sets = _sets_of(docs, cut(classes.select("sig", "rk").join(ids, "sig")), bound, held)
    one = pairs.join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("x")), "a")
    two = one.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(two.withColumn("c", common).where(F.expr(f"100 * c >= {LEAST} * (size(x) + size(y) - c)")).select("a", "b"))


def _block_links(table: pa.Table) -> pa.Table:
    """Links per set between the two blocks of a group (or inside one), by counting common tokens of all pairs at once."""
    sig, own = table.column("sig").to_numpy(), table.column("block").to_numpy()
    sets = [np.asarray(t.as_py(), np.int64) for t in table.column("tokens")]
    size = np.array([len(t) for t in sets])
    uniq, at = np.unique(np.concatenate(sets), return_inverse=True)
    row, by = np.repeat(np.arange(len(sets)), size), np.argsort(at, kind="stable")
    at, row = at[by], row[by]
    common = np.zeros((len(sets), len(sets)), np.int64)
    cuts = np.searchsorted(at, np.arange(0, len(uniq) + _COLUMNS, _COLUMNS))
    for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = np.zeros((len(sets), _COLUMNS), np.float32)
        x[row[a:b], at[a:b] - n * _COLUMNS] = 1
        common += (x @ x.T).astype(np.int64)
    linked = 100 * common >= LEAST * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, False)
    if own.min() != own.max():
        linked &= own[:, None] != own[None, :]
    return pa.table({"v": sig, "links": linked.sum(axis=1).astype(np.int64)})


def _group_links(docs: DataFrame, classes: DataFrame, group_of: DataFrame, bound: int, held: list[DataFrame]) -> DataFrame:
    """v, links: links of each set to others of its group. All pairs of a group are compared, in blocks of its members."""
    needed = cut(classes.select("sig", "rk").join(group_of.withColumnRenamed("v", "sig"), "sig"))
    sets = _sets_of(docs, needed, bound, held)
    blocks = needed.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / _MEMBERS).cast("long").alias("nb"))
    placed = needed.join(blocks, "root").select("sig", "root", F.pmod(F.xxhash64("sig"), F.col("nb")).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    met = placed.select("sig", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "sig")
    return met.groupBy("root", "i", "j").applyInArrow(_block_links, "v long, links long")


def _leader_pairs(features: DataFrame) -> DataFrame:
    """Each document with the leader (smallest signature) of every key it shares: linear in the documents.

    Leaders of very unlike size are left to the exact step.
    """
    keyed = features.where(F.col("bands").isNotNull()).select("sig", "n", F.posexplode("bands").alias("band", "key"))
    led = keyed.groupBy("band", "key").agg(F.min(F.struct("sig", "n")).alias("lead"), F.max("sig").alias("top")).where(F.col("lead.sig") != F.col("top"))
    met = keyed.join(led.select("band", "key", F.col("lead.sig").alias("b"), F.col("lead.n").alias("bn")), ["band", "key"])
    fits = F.expr(f"sig <> b AND 100 * least(n, bn) >= {LEAST} * greatest(n, bn)")
    return met.where(fits).select(F.col("sig").alias("a"), "b").distinct()


#: Share of the summed sizes of two sets by which they may differ and still link.
_SEVENTH = (100 - LEAST) / (100 + LEAST)


def _apart(x: str, y: str) -> Column:
    """Elements by which two sets differ at least: the bits in which their parity sketches do."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(LONGS)), F.lit(0))


def _level(n: Column) -> Column:
    """The level at which a set of ``n`` elements has its own parts, as in set_parts."""
    return F.when(n < 2 * PART, 0).otherwise(F.length(F.bin(F.floor(n / PART))) - 1)


def _least_met(n: Column) -> Column:
    """First tokens that a set of ``n`` elements shares at least with a linked set that is not smaller, as in set_parts."""
    return F.least((OVERLAP * F.pow(F.lit(2), _level(n))).cast("long"), F.ceil(LEAST * n / 100))


def _near_pairs(features: DataFrame, groups: DataFrame, round_: int) -> DataFrame:
    """Pairs of sets of different groups that are likely to link, at most ``NEAREST`` per set: linear in the documents.

    Each key has a few leaders, drawn anew in each round; a set tries those of its keys that lie nearest by sketch.
    """
    grouped = groups.select(F.col("v").alias("sig"), "root")
    sets = features.where(F.col("bands").isNotNull()).select("sig", "n", "bits", "bands").dropDuplicates(["sig"]).join(grouped, "sig", "left")
    sets = sets.select("sig", "n", "bits", "bands", F.coalesce("root", "sig").alias("g"))
    keyed = sets.select("sig", "n", "g", F.posexplode("bands").alias("band", "key"))
    drawn = [F.xxhash64("sig", F.lit(LEADERS * round_ + i)) for i in range(LEADERS)]
    led = keyed.groupBy("band", "key").agg(
        F.array_distinct(F.array(*[F.min_by("sig", d) for d in drawn])).alias("leads"), F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high")
    tried = keyed.join(led, ["band", "key"]).select("sig", "n", "g", F.explode("leads").alias("b")).where("sig <> b").distinct()
    lead = sets.select(F.col("sig").alias("b"), F.col("n").alias("bn"), F.col("g").alias("bg"), F.col("bits").alias("bbits"))
    fits = F.expr(f"g <> bg AND 100 * least(n, bn) >= {LEAST} * greatest(n, bn)")
    tried = tried.join(lead, "b").where(fits).join(sets.select("sig", "bits"), "sig").withColumn("apart", _apart("bits", "bbits"))
    tried = tried.where(F.col("apart") <= (F.col("n") + F.col("bn")) * _SEVENTH)
    best = tried.groupBy("sig").agg(F.slice(F.array_sort(F.collect_list(F.struct("apart", "b"))), 1, NEAREST).alias("best"))
    return best.select(F.col("sig").alias("a"), F.explode("best.b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (v, root) after further links, found by the components of the groups alone."""
    known = groups.select(F.col("v").alias("_v"), F.col("root").alias("_r"))
    ends = links.select("a", "b").join(known, F.col("a") == F.col("_v"), "left").select(F.coalesce("_r", "a").alias("a"), "b")
    ends = ends.join(known, F.col("b") == F.col("_v"), "left").select("a", F.coalesce("_r", "b").alias("b"))
    moved = components(ends).select(F.col("v").alias("_m"), F.col("root").alias("_to"))
    kept = groups.join(moved, F.col("root") == F.col("_m"), "full")
    return cut(kept.select(F.coalesce("v", "_m").alias("v"), F.coalesce("_to", "root").alias("root")).distinct())


def _of_several(tokens: DataFrame, owner: str) -> DataFrame:
    """The rows of tokens that more than one ``owner`` has."""
    token = Window.partitionBy("token")
    return tokens.withColumn("_a", F.min(owner).over(token)).withColumn("_b", F.max(owner).over(token)).where("_a <> _b").drop("_a", "_b")


def _open_pairs(features: DataFrame, group_of: DataFrame) -> DataFrame:
    """Pairs of sets from different groups that may still link, by the token-group matrix.

    The matrix holds the union of each group's prefix tokens, but for tokens that a single group has. Sets that link share
    ``OVERLAP`` prefix tokens for each part of the smaller one (or what it needs at all, if less), so groups with fewer
    common tokens cannot hold a link. The smaller group queries the larger one, and only under a bound on distance: the
    sketches of the groups' first sets, less the radii of their groups, must not differ by more than linked sets may (a
    seventh of their sizes). Groups that qualify are compared by part under the same bound, and only the parts left are
    opened, where their members meet under it.
    """
    listed = features.where(F.col("parts").isNotNull()).select("sig", _level(F.col("n")).alias("level"), F.explode("parts").alias("x"))
    grouped = group_of.select(F.col("v").alias("sig"), "root")
    own = F.shiftright("x.part", 40) == F.col("level")
    parts = listed.select("sig", "x.part", "x.size", "x.bits", own.alias("own")).dropDuplicates(["sig", "part"]).join(grouped, "sig", "left")
    parts = cut(parts.select("sig", F.coalesce("root", "sig").alias("g"), "part", "size", "bits", "own"))
    leads = parts.groupBy("g", "part").agg(F.min_by("bits", "sig").alias("lead"))
    groups = cut(
        parts.join(leads, ["g", "part"])
        .groupBy("g", "part")
        .agg(F.min("size").alias("low"), F.max("size").alias("high"), F.count(F.lit(1)).alias("held"), F.max(_apart("bits", "lead")).alias("radius"), F.max("lead").alias("lead"), F.max("own").alias("own"))
    )
    tokens = listed.where("x.part = 0").select("sig", F.explode("x.prefix").alias("token"))
    shared = _of_several(tokens, "sig").join(grouped, "sig", "left").select("token", F.coalesce("root", "sig").alias("g"))
    whole = groups.where("part = 0").drop("part", "own")
    matrix = cut(_of_several(shared, "g").distinct().join(whole, "g"))
    q, m = matrix.alias("q"), matrix.alias("m")
    smaller = F.expr("q.token = m.token AND (q.held < m.held OR (q.held = m.held AND q.g < m.g))")
    sizes = F.expr(f"100 * m.high >= {LEAST} * q.low AND 100 * q.high >= {LEAST} * m.low")
    near = _apart("q.lead", "m.lead") - F.col("q.radius") - F.col("m.radius") <= (F.col("q.high") + F.col("m.high")) * _SEVENTH
    open_ = cut(
        q.join(m, smaller & sizes & near)
        .groupBy(F.col("q.g").alias("qg"), F.col("m.g").alias("mg"))
        .agg(F.count(F.lit(1)).alias("common"), F.first("q.low").alias("ql"), F.first("m.low").alias("ml"))
        .where(F.col("common") >= _least_met(F.least("ql", "ml")))
        .select("qg", "mg")
    )
    q, m = groups.alias("q"), groups.alias("m")
    # two sets are compared by the parts of the larger one, so one side must have them as its own
    by_part = lookup(open_, open_.count()).join(q, F.expr("qg = q.g")).join(m, F.expr("mg = m.g AND q.part = m.part AND (q.own OR m.own)") & sizes & near)
    by_part = cut(by_part.select("qg", "mg", "q.part"))
    x = lookup(by_part, by_part.count()).join(parts.withColumnRenamed("g", "qg"), ["qg", "part"]).alias("x")
    y = parts.alias("y")
    fits = F.expr(f"x.mg = y.g AND x.part = y.part AND (x.own OR y.own) AND 100 * least(x.size, y.size) >= {LEAST} * greatest(x.size, y.size)")
    close = _apart("x.bits", "y.bits") <= (F.col("x.size") + F.col("y.size")) * _SEVENTH
    return cut(x.join(y, fits & close).select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct())


def _classes(docs: DataFrame, bound: int = BROADCAST_ROWS, count: bool = False) -> DataFrame:
    """near_duplicates with root (smallest signature of the class, null without words); links only if asked to ``count``."""
    source = docs.select("doc_id", "text")
    frequent = frequent_tokens(source)
    schema = f"doc_id long, rk long, sig long, n long, bits array<long>, bands array<long>, parts {_PARTS}"
    keyed = source.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rk"), "text")
    features = cut(keyed.mapInArrow(_features(frequent), schema))
    classes = cut(features.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("rk").alias("rk")))
    held: list[DataFrame] = []  # sets are derived and written once, by the first step that needs them
    groups = cut(components(_verified(source, classes, cut(_leader_pairs(features)), bound, held)))
    for round_ in range(ROUNDS):
        links = _verified(source, classes, cut(_near_pairs(features, groups, round_)), bound, held)
        if links.isEmpty():
            break
        groups = _merged(groups, links)
    # what is left to open are sets whose nearest neighbours outside their group do not link
    reached = _merged(groups, _verified(source, classes, _open_pairs(features, groups), bound, held))
    named = classes.join(reached.withColumnRenamed("v", "sig"), "sig", "left")
    if count:
        named = named.join(_group_links(source, classes, reached, bound, held).groupBy("v").agg(F.sum("links").alias("links")).withColumnRenamed("v", "sig"), "sig", "left")
    else:
        named = named.withColumn("links", F.lit(None).cast("long"))
    named = named.withColumn("root", F.coalesce("root", "sig"))
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    of_class = cut(named.join(ids, "root").select("sig", "root", "component_id", F.coalesce("links", F.lit(0)).alias("links")))
    return features.select("doc_id", "rk", "n", "sig").join(of_class, "sig", "left").select(
        "doc_id",
        "rk",
        F.col("n").alias("n_shingles"),
        "sig",
        "root",
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def near_duplicates(docs: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, rk (content key), n_shingles, sig (equal sets share it), component_id, links.

    Documents link at a Jaccard similarity of 0.75 of their sets of five-word shingles; component_id is the smallest
    doc_id reachable. Equal sets become one class first. Then similar sets are grouped: each is compared with the
    leaders of the min-hash keys it shares, then in rounds with its nearest neighbours outside its group, and verified links
    make the groups. The exact step finds every pair of sets of different groups that may link through the token-group
    matrix, so no link between groups is lost; links inside a group do not change it. ``links``: number of different sets
    to which the document's set links; they all lie in its class and are counted in blocks of its members.

    Null texts and texts without words have an empty set and link with nothing; a null doc_id never becomes a
    component's id unless it has no other; repeated rows are equal sets; an empty table gives an empty table. Only
    doc_id and text are read. Sets are told apart by 64 bits: among n different sets about n * n / 2**65 pairs collide.
    """
    return _classes(docs, bound, count=True).drop("root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of every class of near duplicates: that of the smallest doc_id, then content key.

    Null ids come last. Documents without words link with nothing and all stay. Columns may have any name; an empty table
    stays empty. Rows alike in doc_id and text are told apart from others by 64 bits, so among n rows about n * n / 2**65
    pairs are taken for one.
    """
    found = _classes(docs)
    # classes are told apart by their root: ids may be null or repeated in several of them
    worded = found.where("sig IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).getField("rk").alias("rk"))
    empty = found.where("sig IS NULL").select("rk").distinct()
    keep = cut(worded.select("rk").unionByName(empty).distinct())
    rows = packed(docs).join(keep, "rk", "left_semi")
    has_words = F.length(F.trim(F.regexp_replace(F.coalesce("row.text", F.lit("")), r"[\x09-\x0D]+", " "))) > 0
    once = rows.where(has_words).dropDuplicates(["rk"]).unionByName(rows.where(~has_words))
    return once.select(*unpacked(once, docs.columns))
