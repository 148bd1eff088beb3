"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into bits // 2 + 1 segments, so that of two fingerprints within `bits`
bits some segment differs by one bit at most. Every fingerprint is indexed under each segment
with each of its bits as a wildcard; fingerprints that share an entry are verified against
each other. Each half of a segment is one row to be dealt, by which a task gets all variants of
the other half. Links of one variant leave the task as a chain through each linked set, not as
pairs; large halves are dealt by variant, and variants above `block` fingerprints in pairs of
blocks, so none is ever gathered whole and no link is lost. Components come from the chains by contraction, every round
written to the shared folder.

Links may further be verified by more lanes of 64 bits, made from the same shingle hashes:
then all lanes together must differ in `total` bits at most. `keep_one` takes such links as
candidates only: within each group that they connect, the sets of hashed shingles themselves
are compared, and similarities (Jaccard) of `least` or more are its links. Its segments put an exact
half of one lane beside a wildcard half of another, for `LANES` lanes; the exact half grows with the number of
fingerprints, so that a fingerprint is compared with about as many others in a table of any size. Sets of a few
shingles are indexed by digests with each shingle left out instead, which finds all of their links.

Equal fingerprints are merged before indexing. A null or empty text has the fingerprint zero,
which is linked like any other. Rows that share an id belong to one document each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import WORD, free_name, materialize, text_chunks, texts

WIDTH = 64
#: Columns of the lanes; the first CHECKED ones are compared.
LANES = ("bits", "more", "most", "lane3", "lane4", "lane5", "lane6", "lane7")
CHECKED = 3
#: Shares of up to so many fingerprints are compared by array operations over many shares.
SMALL = 256
#: Rows of such shares that are compared at once.
ROWS = 1 << 15
#: Pairs of larger shares that are compared at once.
PAIRS = 1 << 17


def _bits(hashes: np.ndarray) -> np.ndarray:
    flags = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, WIDTH)
    # A byte holds the sum of 255 rows.
    return sum(flags[i : i + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for i in range(0, len(flags), 255))


def fingerprint(text: str, size: int = 4) -> int:
    """SimHash of the word shingles, repeats included; fewer words: of the whole sequence; none: 0."""
    return lanes(text, size, 1)[0]


def lanes(text: str, size: int = 4, count: int = 2) -> list[int]:
    """`count` fingerprints: that of the shingles' hashes, then those of the hashes multiplied and shifted."""
    return _lanes(_hashes(text, size), count)


def _hashes(text: str, size: int) -> np.ndarray:
    """The hash of every word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    # Of bytes, lower() changes A-Z only, and split() splits at the code points that WORD leaves out.
    raw = text.encode().lower().split()
    if not raw:
        return np.zeros(0, np.uint64)
    size = min(size, len(raw))
    joined = b" ".join(raw)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, stops = [0, *(gaps + 1)[: len(raw) - size].tolist()], [*gaps.tolist(), len(joined)][size - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def _lanes(hashes: np.ndarray, count: int) -> list[int]:
    total = np.zeros((count, WIDTH), np.int64)
    for i in range(0, len(hashes), 8192):
        own = hashes[i : i + 8192]
        for k in range(count):
            total[k] += _bits(own)
            own = (own ^ (own >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
            own ^= own >> np.uint64(32)
    return np.packbits(total * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(df: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", count: int = 1) -> DataFrame:
    """(id, bits[, more]): the fingerprint, and the second lane, as signed 64-bit numbers."""
    names = ["id", "bits", "more"][: count + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([lanes(x, size, count) for x in texts(batch)], np.uint64).reshape(-1, count).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(own[:, k]) for k in range(count))], names=names)

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def segments(bits: int) -> list[tuple[int, int]]:
    """(first bit, size) of the segments for links of up to `bits` bits."""
    n = min(WIDTH, bits // 2 + 1)
    cuts = [WIDTH * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def halves(bits: int) -> list[tuple[str, int, int, str, int, int]]:
    """(lane, first bit, size) of the exact half and of the one with the wildcard, of each segment cut in two, either way."""
    out = []
    for first, size in segments(bits):
        low = size // 2
        two = ("bits", first, low), ("bits", first + low, size - low)
        out += [(*exact, *wild) for exact, wild in (two, two[::-1]) if wild[2]]
    return out


def mixed_halves(count: int, each: int = 8, wild: int = 12, share: int = 1 << 17) -> list[tuple[str, int, int, str, int, int]]:
    """The same for `count` fingerprints of all lanes: `each` wildcard halves a lane, beside exact halves of the next lane.

    Exact halves have 6 bits, and one more whenever the count doubles beyond what gives `share` rows to each of their values.
    For each two of these bits every wildcard half gets another exact one, as fewer copies have them equal.
    """
    size = max(6, ((count - 1) // share).bit_length())
    step, apart = (WIDTH - wild) // (each - 1), (WIDTH - size) // (each - 1)
    rounds = 1 + -(-(size - 6) // 2)
    return [(LANES[(k + 1 + r) % len(LANES)], (apart * i + r * 3) % (WIDTH - size + 1), size, LANES[k], step * i, wild) for k in range(len(LANES)) for r in range(rounds) for i in range(each)]


def _bits_of(column: str, first: int, size: int) -> Column:
    return F.shiftrightunsigned(column, first).bitwiseAND((1 << size) - 1 if size < 63 else -1) if size else F.lit(0).cast("long")


def _parts(own: DataFrame, pieces: list[tuple[str, int, int, str, int, int]], kept: list[str]) -> DataFrame:
    """(part, wild, width, `kept`): a row for each piece; a part is its exact half, wild is what the other half holds.

    Fingerprints whose exact halves are equal and whose other halves differ in one bit share a part.
    """
    made = [
        F.struct((F.lit(i << 40).bitwiseOR(_bits_of(lane, first, size)) if size <= 40 else F.xxhash64(F.lit(i), _bits_of(lane, first, size))).alias("part"), _bits_of(other, start, width).alias("wild"), F.lit(width).alias("width"))
        for i, (lane, first, size, other, start, width) in enumerate(pieces)
    ]
    return own.select(*kept, F.explode(F.array(*made)).alias("e")).select("e.*", *kept)


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _near(values: list[np.ndarray], one, two, bits: int, total: int) -> np.ndarray:
    """Which of the rows `one` and `two` (places that broadcast) are linked, by one lane or more."""
    apart = np.bitwise_count(values[0][one] ^ values[0][two])
    near = apart <= bits
    if len(values) > 1:
        # The other lanes only of pairs that the first one leaves.
        at = np.nonzero(near)
        one, two = (np.broadcast_to(np.arange(len(values[0]))[x] if isinstance(x, slice) else x, near.shape)[at] for x in (one, two))
        near[at] = sum((np.bitwise_count(v[one] ^ v[two]) for v in values[1:]), apart[at].astype(np.int64)) <= total
    return near


def _touching(values: list[np.ndarray], bits: int, total: int) -> np.ndarray:
    """Places of the nodes that have a link, by array operations over blocks of all pairs."""
    n = len(values[0])
    step = max(1, PAIRS // n)
    some = np.zeros(n, bool)
    for a in range(0, n, step):
        own = np.arange(a, min(n, a + step))
        near = _near(values, own[:, None], slice(None), bits, total)
        near[own - a, own] = False
        some[own] = near.any(axis=1)
    return np.flatnonzero(some)


def _chains(nodes: np.ndarray, values: list[np.ndarray], bits: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains through the sets of nodes that links connect."""
    some = _touching(values, bits, total)
    nodes, values = nodes[some], [v[some] for v in values]
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    nodes, values = nodes[order], [v[order] for v in values]
    root = np.arange(n)
    todo = np.ones(n, bool)
    # Grow one set at a time; each node is compared once with all that aren't in a set yet.
    for start in range(n):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            near = rest[_near(values, rest, stack.pop(), bits, total)]
            todo[near] = False
            root[near] = start
            stack.extend(near.tolist())
    order = np.argsort(root, kind="stable")
    same = root[order][1:] == root[order][:-1]
    return nodes[order][:-1][same], nodes[order][1:][same]


def _joined(node: np.ndarray, values: list[np.ndarray], bounds: np.ndarray, bits: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each group of places between bounds: all of a group, or chains where there are many or the group is above SMALL."""
    heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.diff(bounds)
    chained = size > SMALL
    # Small groups: places and those so many places on, for all groups of some rows at once.
    small = np.flatnonzero((size > 1) & ~chained)
    first, n = bounds[small], size[small]
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // ROWS, prepend=-1)) if len(n) else []
    for low, high in zip(cuts, [*cuts[1:], len(n)]):
        own, of = n[low:high], np.repeat(np.arange(high - low), n[low:high])
        starts = np.cumsum(own) - own
        at = np.repeat(first[low:high] - starts, own) + np.arange(len(of))
        names, mine = node[at], [v[at] for v in values]
        left = (starts + own)[of] - np.arange(len(of)) - 1
        todo, found = np.flatnonzero(left), [np.zeros((2, 0), np.int64)]
        for d in range(1, int(own.max())):
            todo = todo[left[todo] >= d]
            near = todo[_near(mine, todo, todo + d, bits, total)]
            found.append(np.stack([near, near + d]))
        a, b = np.concatenate(found, axis=1)
        many = np.bincount(of[a], minlength=len(own)) > 4 * own + 16
        chained[small[low:high][many]] = True
        kept = ~many[of[a]]
        heads.append(np.minimum(names[a[kept]], names[b[kept]]))
        tails.append(np.maximum(names[a[kept]], names[b[kept]]))
    for k in np.flatnonzero(chained):
        part = slice(bounds[k], bounds[k + 1])
        a, b = _chains(node[part], [v[part] for v in values], bits, total)
        heads.append(a)
        tails.append(b)
    return np.concatenate(heads), np.concatenate(tails)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns take new values, 0 included."""
    return np.concatenate([[0], np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1])


def _shares(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, bounds) of whole shares of sorted rows: those that have equal first `keys` columns."""
    rest, end = [np.zeros(0, np.int64) for _ in names], False
    batches = iter(batches)
    while not end:
        batch = next(batches, None)
        end = batch is None
        columns = rest if end else [np.concatenate([r, np.asarray(batch[c]).astype(np.int64)]) for r, c in zip(rest, names, strict=True)]
        n = len(columns[0])
        if not n:
            continue
        bounds = np.concatenate([_starts(*columns[:keys]), [n] * end]).astype(np.int64)
        rest = [c[bounds[-1] :] for c in columns]
        if len(bounds) > 1:
            yield [c[: bounds[-1]] for c in columns], bounds


def links(own: DataFrame, bits: int = 4, block: int = 4096, total: int = 0, most: int = 1 << 16, pieces: list[tuple[str, int, int, str, int, int]] | None = None, lanes_: tuple[str, ...] | None = None) -> DataFrame:
    """(a, b): chains that connect all nodes within `bits` bits (and `total` bits of all lanes).

    `own`: (node, bits[, more, ...]), nodes and fingerprints distinct. With `pieces`, these bring nodes
    together instead of the segments of `bits`; with `lanes_`, only these lanes are compared.

    Rows are dealt by the exact half of a segment; the task makes the wildcard variants of the
    other half. Parts of more than `most` rows are dealt by variant instead, and variants of more
    than `block` rows in pairs of blocks.
    """
    kept = ["node", *lanes_] if lanes_ else own.columns
    parts = _parts(own, pieces or halves(bits), kept)
    # A part is no larger than the table.
    wide = materialize(parts.groupBy("part").count().where(F.col("count") > most).select("part")) if own.count() > most else None
    some = wide is not None and not wide.isEmpty()
    near = (parts.join(wide, "part", "left_anti") if some else parts).select("part", "wild", "width", *kept)
    near = near.repartition("part").sortWithinPartitions("part")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, bounds in _shares(batches, ("part", "wild", "width", *kept), 1):
            wild, width, node, values = columns[1], columns[2], columns[3], [c.view(np.uint64) for c in columns[4:]]
            share = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            found = []
            for bit in range(int(width.max())):
                # Nodes of a share whose other halves are equal but for this bit.
                at = np.flatnonzero(width > bit)
                key = share[at] << 32 | wild[at] & ~(1 << bit)
                order = np.argsort(key)
                at, key = at[order], key[order]
                found.append(_joined(node[at], [v[at] for v in values], np.concatenate([_starts(key), [len(at)]]), bits, total))
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    out = near.mapInArrow(variants, "a long, b long")
    if some:
        far = parts.join(wide, "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
        far = far.select(F.xxhash64("part", "k", F.col("wild").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, k)")))).alias("entry"), *kept)
        # Only entries above a block need their counts; all others are one share.
        large = materialize(far.groupBy("entry").count().where(F.col("count") > block))
        blocks = F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1))
        mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
        both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
        dealt = far.join(large, "entry", "left").select("entry", *kept, F.explode(both).alias("p")).select("entry", F.col("p.i").alias("i"), F.col("p.j").alias("j"), *kept)
        # An entry's share arrives sorted and whole: all its rows have one (entry, i, j).
        dealt = dealt.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns, bounds in _shares(batches, ("entry", "i", "j", *kept), 3):
                a, b = _joined(columns[3], [c.view(np.uint64) for c in columns[4:]], bounds, bits, total)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        out = out.union(dealt.mapInArrow(run, "a long, b long"))
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node of each node's component, for all nodes of `edges` (a, b).

    Each round hangs every node below its smallest neighbour, if that is smaller than itself,
    follows these links to their roots, and keeps the edges between different roots only. So edges
    are joined about once, however large a group is; what is left after a round are its smallest
    nodes. It ends when no edge is left.
    """
    rest = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    label = None
    for _ in range(max_rounds):
        # The smaller end of each edge is a root until it hangs below another itself.
        hung = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
        roots = _followed(materialize(hung.unionByName(rest.select(F.col("a").alias("node"), F.col("a").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))), max_rounds)
        if label is None:
            label = roots
        else:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("up"))
            label = materialize(label.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        for end in ("a", "b"):
            rest = rest.join(roots.select(F.col("node").alias(end), F.col("label").alias("_root")), end).withColumn(end, F.col("_root")).drop("_root")
        rest = materialize(rest.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if rest.isEmpty():
            return label
    raise RuntimeError("components did not settle")


def _followed(label: DataFrame, max_rounds: int) -> DataFrame:
    """(node, label) with every link followed to its end; the way halves in each round."""
    for _ in range(max_rounds):
        up = label.select(F.col("node").alias("label"), F.col("label").alias("up"))
        nearer = materialize(label.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
        label = nearer.select("node", "label")
        if nearer.where("moved").isEmpty():
            return label
    raise RuntimeError("links did not end")


def linked(df: DataFrame, bits: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = 4096, total: int = 0) -> DataFrame:
    """(id, bits[, more], component_id): each document's fingerprint and the smallest id reachable by links."""
    lanes_ = ["bits", "more"] if total else ["bits"]
    own = materialize(fingerprints(df, size, id_col, text_col, len(lanes_)))
    nodes = materialize(own.groupBy(*lanes_).agg(F.min("id").alias("node")).select("node", *lanes_))
    label = components(materialize(links(nodes, bits, block, total)))
    named = materialize(nodes.join(label, "node", "left").select(*lanes_, F.coalesce("label", "node").alias("component_id")))
    return own.join(named, lanes_).select(F.col("id").alias(id_col), *lanes_, "component_id")


def _short(hashes: np.ndarray) -> list[int]:
    """Digests of a set of 4 to 8 shingles, and of one of 5 to 9 without each of them; of other sets none.

    Of sets with fewer than 10 shingles together, those similar by 0.8 and more differ in one: one set's first digest is another's later one.
    """
    if not 4 <= len(hashes) <= 9:
        return []
    whole = np.bitwise_xor.reduce(hashes)
    return [whole, *((whole ^ hashes) if len(hashes) > 4 else [])]


def _sets(df: DataFrame, size: int, count: int) -> DataFrame:
    """(id, key, bits, more, ..., short): digest, lanes and short digests of each row's set of shingles; `df`: (id, text)."""
    names = ["id", "key", *LANES[:count], "short"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = [np.unique(_hashes(x, size)) for x in texts(batch)]
            own = np.array([[xxhash.xxh3_64_intdigest(x.tobytes()), *_lanes(x, count)] for x in found], np.uint64).reshape(-1, count + 1).view(np.int64)
            short = pa.array([np.array(_short(x), np.uint64).view(np.int64) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(own[:, k]) for k in range(count + 1)), short], names=names)

    return df.mapInArrow(run, ", ".join(f"{n} long" for n in names[:-1]) + ", short array<long>")


def _similar(nodes: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Chains through the sets of nodes that pairs of similarity `least` and more connect."""
    n = len(sets)
    size = np.array([len(x) for x in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
    flag = np.zeros(len(kinds), bool)
    rest, heads, tails = np.arange(1, n), [], []
    stack, last = [0], 0
    # Each node is compared once with all that aren't in a set yet; their codes lie side by side.
    held = codes[start[1] :]
    while len(rest):
        if not stack:
            last, held, rest = rest[0], held[size[rest[0]] :], rest[1:]
            stack = [last]
            continue
        x = stack.pop()
        mine = codes[start[x] : start[x + 1]]
        flag[mine] = True
        both = np.add.reduceat(flag[held], np.concatenate([[0], np.cumsum(size[rest])[:-1]]), dtype=np.int64)
        flag[mine] = False
        # A margin for division: a share of exactly `least` is a link.
        near = both >= least * (size[rest] + size[x] - both) - 1e-9
        if near.any():
            for y in rest[near].tolist():
                heads.append(nodes[last])
                tails.append(nodes[y])
                last = y
            stack.extend(rest[near].tolist())
            held, rest = held[np.repeat(~near, size[rest])], rest[~near]
    return np.array(heads, np.int64), np.array(tails, np.int64)


def verified(rows: DataFrame, group: DataFrame, size: int, least: float, most: int = 1 << 20, block: int = 512) -> DataFrame:
    """(a, b): chains that connect all nodes of a group whose sets of shingles are similar by `least`.

    `rows`: (id, text). `group`: (node, key, label), the id and digest of the set of each node,
    and its group. Groups of more than `most` shingles, or `block` nodes, are dealt out in pairs of blocks.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            found = [np.unique(_hashes(x, size)) for x in texts(batch)]
            # Of rows that share an id, those of the node's own set.
            same = [i for i, (x, key) in enumerate(zip(found, batch["key"].to_pylist(), strict=True)) if xxhash.xxh3_64_intdigest(x.tobytes()) == key % (1 << 64)]
            yield pa.RecordBatch.from_arrays([batch["label"].take(pa.array(same, pa.int64())), batch["node"].take(pa.array(same, pa.int64())), pa.array([found[i].tobytes() for i in same], pa.binary())], names=["label", "node", "own"])

    found = rows.join(group, F.col("id") == F.col("node")).select("label", "node", "key", "text").mapInArrow(sets, "label long, node long, own binary")
    found = materialize(found)
    parts = F.greatest(F.ceil(F.sum(F.length("own") / 8) / most), F.ceil(F.count("*") / block)).cast("int")
    large = materialize(found.groupBy("label").agg(parts.alias("parts")).where(F.col("parts") > 1))
    blocks = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(j, mine).alias("i"), F.greatest(j, mine).alias("j")))
    dealt = found.join(large, "label", "left").select("label", "node", "own", F.explode(both).alias("p")).select("label", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "own")
    # A group's share arrives sorted and whole: all its rows have one (label, i, j).
    dealt = dealt.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, nodes, own = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                a, b = _similar(np.array(nodes, np.int64), own, least)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for *at, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != share:
                    yield from done()
                    share, nodes, own = at, [], []
                nodes.append(node)
                own.append(np.frombuffer(raw, np.uint64))
        yield from done()

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def candidates(nodes: DataFrame, cut: int = 26, total: int = 54, most: int = 1 << 19, each: int = 16) -> DataFrame:
    """(a, b): chains between nodes that the pieces of all lanes bring together, and links of short sets.

    At similarity 0.8 lanes differ in about 10 bits each; `cut` (of the first lane) and `total` (of all
    that are checked) lie well above that. `nodes`: (node, short, bits, more, ...).
    """
    short = nodes.where(F.size("short") > 0)
    whole = short.where(F.size("short") != 10).select(F.col("node").alias("a"), F.col("short")[0].alias("digest"))
    less = short.select(F.col("node").alias("b"), F.explode(F.slice("short", 2, 9)).alias("digest"))
    found = materialize(whole.join(less, "digest").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    nodes = nodes.select("node", *LANES)
    pieces = mixed_halves(nodes.count())
    for i in range(0, len(pieces), each):
        # Some pieces at a time, written, so that the shuffle files of these are held only.
        found = found.union(materialize(links(nodes, cut, total=total, most=most, pieces=pieces[i : i + each], lanes_=LANES[:CHECKED])))
    return found.distinct()


def keep_one(df: DataFrame, size: int = 5, total: int = 54, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of `df` that are the first document (smallest id) of their component; all columns stay.

    Links are similarities of `least` and more, by the sets of shingles of `size` words, of pairs
    in one group of candidates. Rows without an id stay. Documents without words are no copies of
    each other: they stay too.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(text_col).rlike(WORD)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lanes_ = list(LANES)
    own = materialize(_sets(rows, size, len(lanes_)))
    nodes = materialize(own.groupBy("key", *lanes_).agg(F.min("id").alias("node"), F.first("short").alias("short")))
    group = components(materialize(candidates(nodes, total=total)))
    label = components(materialize(verified(rows, materialize(nodes.select("node", "key").join(group, "node")), size, least)))
    named = materialize(nodes.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("component_id")))
    key = free_name(df, "_id")
    gone = materialize(own.join(named, "key").where(F.col("id") != F.col("component_id")).select(F.col("id").alias(key)).distinct())
    return df.join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti")
