"""Sequential operators: greedy selection, segmentation and chunking.

Each is a fold over one key's rows, which no window function can express. Folds in time order run over
blocks of rows (operators/blocks), so that a long key is spread over many tasks; greedy selection by score
and the sampling plans take a key's rows, pre-reduced, through applyInPandas: one recording each.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vodlens.operators import blocks
from vodlens.plans.session import ship_package


def folded(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[pd.DataFrame], list], schema: str) -> DataFrame:
    """Runs a fold over each key's rows sorted by `order`; fold returns tuples without the keys."""
    ship_package(rows.sparkSession)
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = pd.DataFrame(fold(pdf), columns=[n for n in names if n not in keys])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[names]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def thin(times: list[float], least: float) -> list[int]:
    """Indexes of the times that lie at least `least` after the last kept one."""
    kept, last = [], None
    for k, t in enumerate(times):
        if last is None or t - last >= least:
            kept.append(k)
            last = t
    return kept


class Thin(blocks.Fold):
    """thin() as a fold: the state is the last kept time."""

    def __init__(self, least: float):
        self.least = least

    def reset(self) -> None:
        self.last = None

    def get(self):
        return self.last

    def set(self, state) -> None:
        self.last = state

    def step(self, item, t) -> list[tuple]:
        if self.last is not None and t - self.last < self.least:
            return []
        self.last = t
        return [(0, 0, (item, t))]


def thinned(rows: DataFrame, keys: list[str], ts: str, item: str, least: float, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, item, ts])
    return blocks.folded(rows, keys, [ts, item], [item, ts], Thin(least), schema, rows_per_block)


def greedy_nms(rows: DataFrame, keys: list[str], ts: str, score: str, item: str, apart: float, cap: int | None = None) -> DataFrame:
    """Best first, each at least `apart` seconds from all kept ones."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, item, ts, score]), "pick int"])

    def fold(pdf: pd.DataFrame) -> list:
        import bisect

        kept: list[float] = []
        out = []
        for i, t, s in pdf[[item, ts, score]].sort_values([score, item], ascending=[False, True]).itertuples(index=False):
            at = bisect.bisect_left(kept, t)
            if (at and t - kept[at - 1] < apart) or (at < len(kept) and kept[at] - t < apart):
                continue
            kept.insert(at, t)
            out.append((i, t, s, len(out) + 1))
            if cap and len(out) >= cap:
                break
        return out

    return folded(rows.select(*keys, item, ts, score), keys, [ts, item], fold, schema)


class Scenes(blocks.Fold):
    """The state is the segment's scene and when it began; its number counts the changes."""

    number_at = 0

    def __init__(self, least: float):
        self.least = least

    def reset(self) -> None:
        self.now, self.since = None, None

    def get(self):
        return self.now, self.since

    def set(self, state) -> None:
        self.now, self.since = state

    def step(self, item, t, scene) -> list[tuple]:
        begins = 0
        if self.since is None:
            self.now, self.since = scene, t
        elif scene != self.now and scene != "UNKNOWN" and t - self.since >= self.least:
            self.now, self.since, begins = scene, t, 1
        return [(begins, 0, (item, t, scene))]


def scene_segments(rows: DataFrame, keys: list[str], ts: str, scene: str, item: str, least: float = 60.0, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """A new segment begins where the scene differs from the segment's, is known, and `least` seconds have passed."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"segment_id int, {item} {kinds[item]}, {ts} {kinds[ts]}, {scene} string"])
    return blocks.folded(rows, keys, [ts, item], [item, ts, scene], Scenes(least), schema, rows_per_block)


class Chunks(blocks.Fold):
    """The state is the chunk that is open."""

    number_at = 0

    def __init__(self, span: float, back: float):
        self.span, self.back = span, back

    def reset(self) -> None:
        self.held, self.begin, self.last = [], 0.0, 0.0

    def get(self):
        return list(self.held), self.begin, self.last

    def set(self, state) -> None:
        self.held, self.begin, self.last = list(state[0]), *state[1:]

    def step(self, start, end, text) -> list[tuple]:
        out = []
        if self.held and end - self.begin > self.span:
            out = self.close()
            self.held, self.begin = [], max(0.0, start - self.back)
        elif not self.held:
            self.begin = start
        self.held.append(text)
        self.last = end
        return out

    def close(self) -> list[tuple]:
        return [(0, 1, (self.begin, self.last, " ".join(self.held)))] if self.held else []


def chunked(rows: DataFrame, keys: list[str], start: str, end: str, text: str, span: float = 15.0, back: float = 3.0, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """Transcript chunks of at most `span` seconds; a later chunk's start is set `back` seconds earlier."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "chunk_no int, start_sec double, end_sec double, text string"])
    return blocks.folded(rows.where(F.trim(text) != ""), keys, [start, end, text], [start, end, text], Chunks(span, back), schema, rows_per_block)


class Captions(blocks.Fold):
    """The state is the line that is open."""

    number_at = 0

    def __init__(self, most: int, gap: float):
        self.most, self.gap = most, gap

    def reset(self) -> None:
        self.held = []

    def get(self):
        return list(self.held)

    def set(self, state) -> None:
        self.held = list(state)

    def step(self, *row) -> list[tuple]:
        out = []
        if self.held and (len(self.held) >= self.most or row[0] - self.held[-1][1] > self.gap):
            out = self.close()
            self.held = []
        self.held.append(row)
        return out

    def close(self) -> list[tuple]:
        return [(0, 1, (self.held[0][0], self.held[-1][1], " ".join(h[2] for h in self.held)))] if self.held else []


def caption_lines(rows: DataFrame, keys: list[str], start: str, end: str, word: str, most: int = 5, gap: float = 0.8, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """Caption lines of at most `most` words without a pause of over `gap` seconds."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "line_no int, start_sec double, end_sec double, text string"])
    return blocks.folded(rows, keys, [start, end], [start, end, word], Captions(most, gap), schema, rows_per_block)


class Group:
    """The rows of one token set that no cluster has: in order, with how often each author is among them."""

    def __init__(self, tokens: frozenset):
        self.tokens, self.rows, self.authors, self.near = tokens, deque(), {}, set()


class Leaders(blocks.Fold):
    """The state is the rows of the latest window that no cluster has; a seed is decided when its window is over.

    Rows of equal token sets (given as lists, or faster as their JSON texts) are one group that knows its
    authors, so that a seed looks at the groups like its own and not at the rows of its window.
    """

    def __init__(self, similar: float, within: float, authors: int):
        self.similar, self.within, self.authors = similar, within, authors

    def reset(self) -> None:
        self.held, self.groups, self.holders = deque(), {}, {}
        self.left, self.sign = 0, 0

    def get(self):
        return [h[:4] for h in self.held if h[4]]

    def mark(self):
        return self.left, self.sign

    def set(self, state) -> None:
        self.reset()
        for h in state:
            self.hold(*h)

    def group(self, name) -> Group:
        """The group of a token set, with the present groups that are similar to it."""
        g = self.groups.get(name)
        if g is None:
            g = self.groups[name] = Group(frozenset(json.loads(name)) if isinstance(name, str) else name)
            beside = {n for t in g.tokens for n in self.holders.get(t, ())} if self.similar > 0 else set(self.groups) - {name}
            for n in beside:
                other = self.groups[n]
                if len(g.tokens & other.tokens) / len(g.tokens | other.tokens) >= self.similar:
                    g.near.add(n)
                    other.near.add(name)
            for t in g.tokens:
                self.holders.setdefault(t, set()).add(name)
        return g

    def hold(self, t, item, author, name) -> None:
        g = self.groups.get(name) or self.group(name)
        h = [t, item, author, name, True]
        self.held.append(h)
        g.rows.append(h)
        g.authors[author] = g.authors.get(author, 0) + 1
        self.left, self.sign = self.left + 1, self.sign ^ hash((item, t))

    def dropped(self, name, g: Group) -> None:
        del self.groups[name]
        for n in g.near:
            self.groups[n].near.discard(name)
        for t in g.tokens:
            names = self.holders[t]
            names.discard(name)
            if not names:
                del self.holders[t]

    def release(self, h: list) -> None:
        h[4] = False
        self.left, self.sign = self.left - 1, self.sign ^ hash((h[1], h[0]))

    def decided(self) -> list[tuple]:
        """The oldest row as a seed, with the rows of its window."""
        seed = self.held.popleft()
        t, item, author, name, free = seed
        if not free:
            return []
        g = self.groups[name]
        if self.similar > 1:  # not even equal sets are similar: the seed is alone
            parts, distinct = [], {author}
        else:
            parts = [(name, g), *((n, self.groups[n]) for n in g.near)]
            distinct = g.authors.keys() if len(parts) == 1 else {a for _, p in parts for a in p.authors}
        if len(distinct) >= self.authors:
            n_authors, rows = len(distinct), [h for _, p in parts for h in p.rows] or [seed]
            self.left -= len(rows)
            for h in rows:
                h[4] = False
                self.sign ^= hash((h[1], h[0]))
            out = [(0, 0, (item, t, max(h[0] for h in rows), n_authors, len(rows)))]
            for n, p in parts:
                self.dropped(n, p)
            if parts:
                return out
        else:
            out = []
            self.release(seed)
        g.rows.popleft()
        if g.authors[author] == 1:
            del g.authors[author]
        else:
            g.authors[author] -= 1
        if not g.rows:
            self.dropped(name, g)
        return out

    def step(self, t, item, author, name) -> list[tuple]:
        out, held = [], self.held
        while held:
            if not held[0][4]:
                held.popleft()
            elif t - held[0][0] > self.within:
                out += self.decided()
            else:
                break
        if not isinstance(name, str):
            name = frozenset(name or ())
        if name and name != "[]":
            self.hold(t, item, author, name)
        return out

    def close(self) -> list[tuple]:
        out = []
        while self.held:
            out += self.decided()
        return out


def leader_clusters(rows: DataFrame, keys: list[str], ts: str, item: str, author: str, tokens: str, similar: float = 0.65, within: float = 10.0, authors: int = 5, rows_per_block: int = blocks.ROWS_PER_BLOCK, split: Callable[[Column], Column] | None = None) -> DataFrame:
    """Clusters around seeds in time order: later rows within `within` seconds of the seed whose token sets are `similar`.

    split: makes the token set where `tokens` is a text; that way it is made once per row, in the blocks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"seed {kinds[item]}, start_sec double, end_sec double, n_authors int, n_rows int"])
    found = F.col(tokens) if split is None else split(F.col(tokens))
    name = {tokens: F.to_json(F.sort_array(F.array_distinct(found)))}
    return blocks.folded(rows, keys, [ts, item], [ts, item, author, tokens], Leaders(similar, within, authors), schema, rows_per_block, name)


class Emas(blocks.Fold):
    """The state is the running mean and variance; every window that stands out is given out."""

    def __init__(self, window_sec: float, least: int, least_authors: int, z: float, rate: float):
        self.window_sec, self.least, self.least_authors, self.z, self.rate = window_sec, least, least_authors, z, rate

    def reset(self) -> None:
        self.mean, self.var = 0.0, 0.05

    def get(self):
        return self.mean, self.var

    def set(self, state) -> None:
        self.mean, self.var = state

    def step(self, at, n, authors) -> list[tuple]:
        if n < self.least or authors < self.least_authors:
            return []
        velocity = n / self.window_sec
        score = (velocity - self.mean) / (max(0.001, self.var) ** 0.5 + 0.05)
        self.mean += self.rate * (velocity - self.mean)
        self.var += self.rate * ((velocity - self.mean) ** 2 - self.var)
        return [(0, 0, (at, n, score))] if score >= self.z else []


def ema_bursts(windows: DataFrame, keys: list[str], order: str, count: str, authors: str, window_sec: float = 10.0, least: int = 4, least_authors: int = 3, z: float = 3.0, rate: float = 0.25, rows_per_block: int = blocks.ROWS_PER_BLOCK) -> DataFrame:
    """Per key, the first window whose velocity stands out from the running mean and variance of earlier ones.

    Only windows with enough rows and authors count, and each updates the averages once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"{order} {kinds[order]}, {count} long, z_score double"])
    found = blocks.folded(windows, keys, [order], [order, count, authors], Emas(window_sec, least, least_authors, z, rate), schema, rows_per_block)
    first = found.groupBy(*keys).agg(F.min_by(F.struct(order, count, "z_score"), order).alias("f"))
    return first.select(*keys, "f.*")


def merged_spans(spans: list[tuple[float, float]]) -> tuple[list[float], list[float]]:
    """Starts and ends of the union of closed intervals, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def stepped(end: float, spans: list[tuple[float, float]], fine: float, coarse: float) -> list[float]:
    """Times from 0 on: steps of `fine` within the spans and `coarse` outside."""
    import bisect

    starts, ends = merged_spans(spans)
    t, out = 0.0, []
    while t < end:
        out.append(t)
        k = bisect.bisect_right(starts, t) - 1
        t += fine if k >= 0 and t <= ends[k] else coarse
    return out


def sample_times(bursts: DataFrame, keys: list[str], duration: str, low: str, high: str, fine: float = 0.5, coarse: float = 5.0) -> DataFrame:
    """Sampling timestamps: steps of `fine` within merged burst intervals and `coarse` outside, 0.15 s apart at least."""
    kinds = {f.name: f.dataType.simpleString() for f in bursts.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "timestamp_sec double"])

    def fold(pdf: pd.DataFrame) -> list:
        spans = [(a, b) for a, b in pdf[[low, high]].itertuples(index=False) if a == a and a is not None]
        out = [round(x, 3) for x in stepped(float(pdf[duration].iloc[0]), spans, fine, coarse)]
        return [(out[k],) for k in thin(out, 0.15)]

    return folded(bursts.select(*keys, duration, low, high), keys, [low], fold, schema)


def sampling_plan(bounds: DataFrame, bursts: DataFrame, cuts: DataFrame, keys: list[str], fine: float = 0.5, coarse: float = 5.0, after_cut: float = 0.1) -> DataFrame:
    """sample_times with bursts of any kind (keys, lo, hi) and a sample just after each scene cut (keys, cut)."""
    kinds = {f.name: f.dataType.simpleString() for f in bounds.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "timestamp_sec double"])
    none = F.lit(None).cast("double")
    rows = bounds.select(*keys, "duration", none.alias("lo"), none.alias("hi"), none.alias("cut"))
    rows = rows.unionByName(bursts.select(*keys, none.alias("duration"), "lo", "hi", none.alias("cut"))).unionByName(cuts.select(*keys, none.alias("duration"), none.alias("lo"), none.alias("hi"), "cut"))

    def fold(pdf: pd.DataFrame) -> list:
        end = pdf["duration"].max()
        if not end > 0:
            return []
        spans = list(pdf[["lo", "hi"]].dropna().itertuples(index=False, name=None))
        times = {round(x, 3) for x in stepped(float(end), spans, fine, coarse)}
        times |= {round(x + after_cut, 3) for x in pdf["cut"].dropna() if 0 <= x < end}
        out = sorted(t for t in times if t <= end)
        return [(out[k],) for k in thin(out, 0.15)]

    return folded(rows, keys, ["lo"], fold, schema)
