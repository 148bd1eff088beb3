"""Secret scans: base patterns, and a character convolutional network over further candidates.

Candidates are tokens of 12 and more characters. The network reads windows of characters over
the whole of each one and what stands before and after it, knowing which characters are the
candidate's; the largest score counts. It is one embedding, one convolution, a maximum over
positions and a logistic output.

It is trained on all candidates that base patterns find against all ordinary ones, placed as in
scanning; equal windows are learned once. As base findings have few alphabets, each is also learned with its value redrawn from
others, in its own surroundings or in those of an ordinary token; ordinary tokens are also learned
joined to names, paths, dates, numbers and addresses. The threshold is the largest that keeps the asked
recall on all findings of a fifth of the tokens that isn't learned from. Base findings always stay; the network
adds spans.

Windows are dealt into shards of like size by their hashes. The first shard's network is where
every shard sets out from; each goes once over its own windows, and the weights are averaged.

A null or empty text has no spans. Offsets are code points, ends exclusive. Rows are scanned one
by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_chunks, texts

#: The base kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = ("password", "passwd", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
DIGIT = re.compile("[0-9]")
WINDOW, BEFORE, STEP = 96, 40, 48
#: Embedding, filters and their width; least findings (and ordinary tokens) of a shard; steps of one in averaged weights, in logits.
EMBED, FILTERS, WIDTH = 8, 24, 5
LEAST, FINE, CELLS = 1024, float(1 << 32), 1024
#: Character classes; those of a candidate's own characters come after those of others.
CLASSES = 98
#: Alphabets that values of findings are redrawn from.
ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", f"{string.ascii_letters}{string.digits}", f"{string.ascii_letters}{string.digits}-_", f"{string.ascii_letters}{string.digits}+/", f"{string.ascii_uppercase}{string.digits}", f"{string.ascii_lowercase}{string.digits}", string.ascii_letters)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, in order of start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of tokens of 12 or more characters."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def free(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[bool]:
    """Which of the candidates overlap no base span; both are in order of start."""
    out, at, reach = [], 0, 0
    for s, e in found:
        # Spans that begin before the candidate's end: the furthest end of them decides.
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        out.append(reach <= s)
    return out


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 127, np.maximum(codes, 31) - 30, CLASSES - 1).astype(np.uint8)


def _cut(text: str, first: int, start: int, end: int) -> np.ndarray:
    out = np.zeros(WINDOW, np.uint8)
    own = _classes(text[max(0, first) : first + WINDOW])
    at = max(0, -first)
    out[at : at + len(own)] = own
    out[max(0, start - first) : max(0, end - first)] += CLASSES
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """Character classes from before a candidate's start; 0 outside the text."""
    return _cut(text, start - BEFORE, start, end)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Overlapping windows from before a candidate's start to behind its end."""
    last = max(start - BEFORE, end + BEFORE - WINDOW)
    return np.array([_cut(text, first, start, end) for first in [*range(start - BEFORE, last, STEP), last]])


def largest(net: Network, found: list[np.ndarray]) -> np.ndarray:
    """The largest score of each candidate's windows."""
    if not found:
        return np.zeros(0)
    at = np.cumsum([0, *map(len, found[:-1])])
    return np.maximum.reduceat(net.scores(np.concatenate(found)), at)


def replaced(x: np.ndarray, value: str, around: np.ndarray | None = None) -> np.ndarray:
    """A window with another value at the candidate's place, in its own surroundings or another window's."""
    around = x if around is None else around
    own = around >= CLASSES
    behind = around[BEFORE + int(own[BEFORE:].argmin() if not own[BEFORE:].all() else WINDOW - BEFORE) :]
    made = np.concatenate([around[:BEFORE], _classes(value) + CLASSES, behind])[:WINDOW]
    return np.concatenate([made, np.zeros(WINDOW - len(made), np.uint8)])


def token_of(x: np.ndarray) -> str:
    """The candidate's characters in a window."""
    own = x[BEFORE:][x[BEFORE:] >= CLASSES].astype(int) - CLASSES + 30
    return "".join(map(chr, own))


def varied(x: np.ndarray, y: np.ndarray, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All the samples, findings with redrawn values, and ordinary tokens joined to names, paths, dates, addresses and UUIDs."""
    rng = random.Random(seed)
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return x, y
    words = [w for w in dict.fromkeys(w for b in bad for w in re.findall("[A-Za-z]+", token_of(b))) if len(w) > 2] or ["word"]
    new_good, new_bad = [], []

    def value() -> str:
        own = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(16, 48)))
        return own if rng.random() < 0.7 else rng.choice(words)[: rng.randint(2, 5)].lower() + rng.choice("_-") + own

    def part() -> str:
        own = rng.choice(words)
        return rng.choice((own.lower(), own.lower(), own.capitalize(), own.upper()))

    def number(most: int) -> str:
        return str(rng.randint(0, most))

    def plain() -> str:
        kind = rng.randrange(11)
        if kind == 0:
            return f"{part()}{number(99)}.{part()}.{rng.choice(('com', 'org', 'net', 'de'))}"
        if kind == 1:
            return ".".join(number(255) for _ in range(4)).ljust(12, "0")
        if kind == 2:
            return f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}" + rng.choice(("T10", f"-{part()}", f".{number(99)}"))
        if kind == 3:
            return "".join(part().capitalize() for _ in range(3)) + rng.choice(("", number(9)))
        if kind == 4:
            return "".join(part().upper() for _ in range(3))[: rng.randint(12, 24)]
        if kind == 5:
            return rng.choice((number(10**15).zfill(12), f"+{number(99)}-{number(999)}-{number(999)}-{number(9999)}".ljust(12, "0")))
        if kind >= 9:
            own = "-".join("".join(rng.choices("0123456789abcdef", k=n)) for n in (8, 4, 4, 4, 12))
            return own.upper() if kind == 10 and rng.random() < 0.5 else own
        sep = rng.choice("-_./")
        return sep.join(part() for _ in range(rng.randint(2, 4))) + rng.choice(("", f"{sep}{number(2030)}", f"-v{number(9)}.{number(20)}", ".html"))

    # As many as bring findings to about a third of all samples.
    for g in (g for g in good for _ in range(max(1, len(bad) * 3 // (4 * len(good))))):
        new_good.append(replaced(g, value()))
        new_good.append(replaced(g, value(), bad[rng.randrange(len(bad))]))
    for b in bad:
        new_bad.append(replaced(b, plain()))
        new_bad.append(replaced(b, token_of(b), bad[rng.randrange(len(bad))]))
    made = [x, np.array(new_good, np.uint8), np.array(new_bad, np.uint8)]
    return np.concatenate(made), np.concatenate([y, np.ones(len(new_good), np.float32), np.zeros(len(new_bad), np.float32)])


@dataclass
class Network:
    """Weights: embedding (2 CLASSES x e), filters (width x e x f), output (f) and bias; threshold of acceptance."""

    embedding: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    output: np.ndarray
    bias: float
    threshold: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))

    def _forward(self, x: np.ndarray):
        width, e, f = self.filters.shape
        embedded = self.embedding[x]
        views = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, width * e)
        hidden = views @ self.filters.reshape(-1, f) + self.shift
        best = hidden.argmax(axis=1)
        top = np.maximum(np.take_along_axis(hidden, best[:, None, :], axis=1)[:, 0], 0)
        return views, best, top, top @ self.output + self.bias

    @classmethod
    def drawn(cls, seed: int = 7) -> Network:
        """Weights to begin with."""
        rng = np.random.default_rng(seed)
        p = [rng.normal(0, 0.3, (2 * CLASSES, EMBED)), rng.normal(0, 0.2, (WIDTH, EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS)]
        return cls(*(a.astype(np.float32) for a in p), 0.0)

    def none(self) -> Network:
        """The same, but nothing is accepted: where there are no findings to learn from, or nothing else."""
        return Network(self.embedding, self.filters, self.shift, self.output * 0, -9.0)

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([self.embedding.ravel(), self.filters.ravel(), self.shift, self.output, [self.bias]])

    def of(self, flat: np.ndarray) -> Network:
        """A network of this one's shape with other weights."""
        shapes = [a.shape for a in (self.embedding, self.filters, self.shift, self.output)]
        cuts = np.split(np.asarray(flat).astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes]))
        return Network(*(c.reshape(s) for c, s in zip(cuts, shapes, strict=False)), float(cuts[-1][0]))

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.01, seed: int = 7) -> Network:
        """Go over the samples by Adam, from these weights."""
        rng = np.random.default_rng(seed)
        width, e, f = self.filters.shape
        p = [self.embedding, self.filters, self.shift, self.output, np.array([self.bias], np.float32)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                views, best, top, z = Network(p[0], p[1], p[2], p[3], float(p[4][0]))._forward(x[part])
                d = ((1 / (1 + np.exp(-z)) - y[part]) / len(part)).astype(np.float32)
                dtop = d[:, None] * p[3] * (top > 0)
                chosen = views[np.arange(len(part))[:, None], best]
                dfilters = (dtop[:, :, None] * chosen).sum(axis=0).T
                dchosen = (dtop[:, :, None] * p[1].reshape(-1, f).T).reshape(-1, e)
                where = x[part][np.arange(len(part))[:, None, None], best[:, :, None] + np.arange(width)].ravel()
                dembedding = np.stack([np.bincount(where, own, len(p[0])) for own in dchosen.T], axis=1).astype(np.float32)
                grads = [dembedding, dfilters.reshape(p[1].shape), dtop.sum(0), top.T @ d, d.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] = (p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return Network(p[0], p[1], p[2], p[3], float(p[4][0]))

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, recall: float = 0.99, epochs: int = 6, seed: int = 7) -> Network:
        """Fit to samples at hand, with varied ones; a fifth of them is held out first to choose the threshold.

        Equal tokens are on one side, and variants of a sample are on the side of that sample.
        """
        net = cls.drawn(seed)
        side = np.array([held_out(token_of(w) or w.tobytes()) for w in x], bool)
        if len(np.unique(y[~side])) < 2:
            return net.none()
        (x, y), (held_x, held_y) = varied(x[~side], y[~side]), varied(x[side], y[side], seed=6)
        net = net.learn(x, y, epochs, seed=seed)
        good = np.sort(net.scores(held_x[held_y == 1]))
        net.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
        return net


def held_out(token: str | bytes) -> bool:
    return xxhash.xxh64_intdigest(token) % 5 == 0


def labelled(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(finding, held, window): every candidate, whether base patterns find it, and whether its token is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows: list[tuple[bool, bool, bytes]] = []
            for text in texts(batch):
                base = base_spans(text) if text else []
                found = candidates(text)
                for (s, e), own in zip(found, free(found, base), strict=True):
                    if not own and text[s:e].isdecimal():
                        # Mere numbers that a pattern finds say nothing of secrets.
                        continue
                    # Of longer tokens a window shows so much.
                    rows.append((not own, held_out(text[s : min(e, s + WINDOW - BEFORE)]), window(text, s, e).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["finding", "held", "window"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "finding boolean, held boolean, window binary")


def dealt(pool: DataFrame, held: bool, counts: dict[tuple[bool, bool], int], shards: int) -> DataFrame:
    """(shard, finding, window): the side's windows by hash; the rarer label's go to several shards where one would have too few."""
    copies = {own: min(shards, -(-LEAST * shards // max(1, counts.get((held, own), 0)))) for own in (False, True)}
    first = F.pmod(F.xxhash64("window"), F.lit(shards))
    further = F.explode(F.sequence(F.lit(0), F.when(F.col("finding"), copies[True] - 1).otherwise(copies[False] - 1)))
    rows = pool.where(F.col("held") == held).select("finding", "window", first.alias("first"), further.alias("further"))
    return rows.select(((F.col("first") + F.col("further")) % shards).cast("int").alias("shard"), "finding", "window")


def samples(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A shard's windows and labels, in an order of their own."""
    rows = sorted(zip(table["window"].to_pylist(), table["finding"].to_pylist(), strict=True))
    return np.array([np.frombuffer(w, np.uint8) for w, _ in rows], np.uint8).reshape(len(rows), WINDOW), np.array([own for _, own in rows], np.float32)


def learned(rows: DataFrame, net: Network, shards: int, epochs: int, rate: float) -> Network:
    """The mean of what the shards' networks become; sums are of whole numbers, so their order doesn't matter."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        x, y = varied(*samples(table), seed=2 * shard + 5)
        flat = net.learn(x, y, epochs, rate, seed=7 + shard).flat()
        return pa.table({"at": pa.array(range(len(flat)), pa.int32()), "value": pa.array(np.rint(flat * FINE).astype(np.int64))})

    made = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "at int, value long")
    means = made.groupBy("at").agg((F.sum("value") / F.count("value") / FINE).alias("value")).orderBy("at").collect()
    return net.of(np.array([r["value"] for r in means]))


def accepted(rows: DataFrame, net: Network, shards: int, recall: float) -> float:
    """The largest threshold, in steps of 1/1024 of the logit, that keeps the recall on all findings and their variants."""

    def run(table: pa.Table) -> pa.Table:
        x, y = varied(*samples(table), seed=2 * table["shard"][0].as_py() + 6)
        cells = np.floor(np.clip(net.logits(x[y == 1]), -32, 32) * CELLS).astype(np.int32)
        cell, n = np.unique(cells, return_counts=True)
        return pa.table({"cell": pa.array(cell, pa.int32()), "n": pa.array(n, pa.int64())})

    made = rows.repartition(shards, "shard").groupBy("shard").applyInArrow(run, "cell int, n long")
    counts = made.groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    below, least = 0, int((1 - recall) * sum(r["n"] for r in counts))
    for r in counts:
        below += r["n"]
        if below > least:
            return float(1 / (1 + np.exp(-np.float32(r["cell"] / CELLS))))
    return 0.5


def fit(df: DataFrame, recall: float = 0.99, text_col: str = "text", shard: int = 8192) -> Network:
    """Train the network on every candidate of the texts, about `shard` of the commoner label in one task."""
    pool = materialize(labelled(df, text_col).distinct())
    counts = {(r["held"], r["finding"]): r["count"] for r in pool.groupBy("held", "finding").count().collect()}
    net = Network.drawn()
    if not counts.get((False, True)) or not counts.get((False, False)):
        return net.none()
    shards = {held: max(1, *(-(-counts.get((held, own), 0) // shard) for own in (False, True))) for held in (False, True)}
    rows = dealt(pool, False, counts, shards[False])
    net = learned(rows.where("shard = 0"), net, 1, epochs=6, rate=0.01)
    if shards[False] > 1:
        net = learned(rows, net, shards[False], epochs=1, rate=0.003)
    net.threshold = accepted(dealt(pool, True, counts, shards[True]), net, shards[True], recall)
    return net


def scan(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): spans as array of (kind, start, end, score), in order of start, then kind.

    Kind is assign, access, hex or, for what the network adds, net. Added spans don't overlap base ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in text_chunks(batches):
            found, asked, cuts = [], [], []
            for i, text in enumerate(texts(batch)):
                base = base_spans(text) if text else []
                found.append([(s, k, e, 1.0) for s, k, e in base])
                own = candidates(text)
                for (s, e), alone in zip(own, free(own, base), strict=True):
                    if alone:
                        asked.append((i, s, e))
                        cuts.append(windows(text, s, e))
            for (i, s, e), score in zip(asked, largest(net, cuts).tolist(), strict=True):
                if score >= net.threshold:
                    found[i].append((s, len(KINDS), e, score))
            names = (*KINDS, "net")
            spans = [[{"kind": names[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(spans, kind)], names=["id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>").withColumnRenamed("id", id_col)


def redact(df: DataFrame, net: Network, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """`df` with every span of `scan` replaced by `mark`; other texts stay as they are, null stays null."""
    names = df.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text_col):
            out, asked, cuts = [], [], []
            rows = batch[at].to_pylist()
            spans: list[list[tuple[int, int]]] = []
            for i, text in enumerate(rows):
                base = base_spans(text) if text else []
                spans.append([(s, e) for s, _, e in base])
                own = candidates(text or "")
                for (s, e), alone in zip(own, free(own, base), strict=True):
                    if alone:
                        asked.append((i, s, e))
                        cuts.append(windows(text, s, e))
            for (i, s, e), score in zip(asked, largest(net, cuts), strict=True):
                if score >= net.threshold:
                    spans[i].append((s, e))
            for text, own in zip(rows, spans, strict=True):
                done, parts = 0, []
                for s, e in sorted(own):
                    if s >= done:
                        parts += [text[done:s], mark]
                    done = max(done, e)
                out.append("".join([*parts, text[done:]]) if own else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
