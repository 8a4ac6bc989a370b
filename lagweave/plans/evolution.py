"""Evolutionary mining: graphs of judgement nodes, evolved for rules that pass the gates.

The generation loop runs inside one task per (target, trial); tasks are spread by Spark. A task holds one bitmap per attribute
and delay over the series' rows, 64 rows to a word. All individuals and start nodes walk their graphs at once: a step is one AND
and one count of bits over all of them; gates are counts of bits too, and a rule is judged once. The seed is a hash of target
and trial, so the same input gives the same rules on any cluster. A cell that is neither 0 nor 1 is no match: a walk that
goes on from it cannot come to count one, so it needs no bitmap of its own.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagweave.params import MiningParams
from lagweave.session import stored

SCHEMA = "inst string, trial int, seq int, generation int, rule string, k int, max_d int, support_count long, support_rate double, concentration double, quadrant string, x1_mean double, x1_sigma double, x1_min double, x1_max double, x2_mean double, x2_sigma double, x2_min double, x2_max double, high_support boolean, low_variance boolean"
LOG = "inst string, trial int, generation int, rules int, best_fitness double, mean_fitness double"


def rule_statistics(flags: np.ndarray, x: np.ndarray, rule: tuple, p: MiningParams) -> dict | None:
    """Statistics of a rule ((attr, delay), ...) over its valid rows; None without a match. flags: attributes x rows."""
    n, deep = flags.shape[1], max(d for _, d in rule)
    t = np.arange(deep, n - p.future_span)
    hit = np.ones(len(t), bool)
    for a, d in rule:
        hit &= flags[a, t - d]
    t = t[hit]
    x1, x2 = x[t + 1], x[t + 2]
    known = ~(np.isnan(x1) | np.isnan(x2))
    x1, x2 = x1[known], x2[known]
    if not len(x1):
        return None
    up1, up2 = x1 >= 0, x2 >= 0
    quads = [int(np.sum(a & b)) for a, b in ((up1, up2), (~up1, up2), (~up1, ~up2), (up1, ~up2))]
    top = int(np.argmax(quads))
    out = {"support_count": len(x1), "support_rate": len(x1) / (n - deep - p.future_span), "concentration": quads[top] / len(x1), "quadrant": f"Q{top + 1}", "max_d": deep}
    for name, v in (("x1", x1), ("x2", x2)):
        out |= {f"{name}_mean": v.mean(), f"{name}_sigma": v.std(), f"{name}_min": v.min(), f"{name}_max": v.max()}
    return out


def passes(s: dict, p: MiningParams) -> bool:
    """The gates: concentration, deviation on the sides away from the quadrant, support."""
    right, top = s["quadrant"] in ("Q1", "Q4"), s["quadrant"] in ("Q1", "Q2")
    calm1 = s["x1_min"] >= -p.max_deviation if right else s["x1_max"] <= p.max_deviation
    calm2 = s["x2_min"] >= -p.max_deviation if top else s["x2_max"] <= p.max_deviation
    return s["concentration"] >= p.min_concentration and calm1 and calm2 and s["support_rate"] >= p.min_support


#: Fixed value: what the fitness gains by a rule that is new.
NEW_RULE = 20


def concentration_fitness(k: int, s: dict) -> float:
    """Length, support and concentration, its lack counting against."""
    return k + 10 * s["support_rate"] + 10 * s["concentration"] - 10 * (1 - s["concentration"])


def tightness_fitness(k: int, s: dict) -> float:
    """Length, support and the inverse deviations of the future values."""
    return k + 10 * s["support_rate"] + 2 / (s["x1_sigma"] + 0.001) + 2 / (s["x2_sigma"] + 0.001)


def _words(bits: np.ndarray) -> np.ndarray:
    """The last axis packed, 64 to a word."""
    packed = np.packbits(bits, axis=-1)
    short = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (bits.ndim - 1) + [(0, short)])).view(np.uint64)


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1, dtype=np.int64)


class Panel:
    """Bitmaps of the panel, and of the rows in each quadrant and beyond each deviation, for one target."""

    def __init__(self, flags: np.ndarray, x: np.ndarray, p: MiningParams):
        self.flags, self.x, self.p, self.n = flags, x, p, flags.shape[1]
        self.last = max(0, self.n - p.future_span)
        lags = p.max_delay + 1
        moved = np.zeros((len(flags), lags, self.last), bool)
        for d in range(lags):
            moved[:, d, d:] = flags[:, : max(0, self.last - d)]
        self.hits = _words(moved).reshape(len(flags) * lags, -1)  # row: attribute times lags, plus delay
        x1, x2 = x[1 : self.last + 1], x[2 : self.last + 2]
        known = ~(np.isnan(x1) | np.isnan(x2))
        right, top, far = x1 >= 0, x2 >= 0, p.max_deviation
        self.known = _words(known)
        self.quadrants = [_words(known & m) for m in (right & top, ~right & top, ~right & ~top, right & ~top)]
        low1, high1, low2, high2 = (known & m for m in (x1 < -far, x1 > far, x2 < -far, x2 > far))
        self.beyond = np.stack([_words(m) for m in (low1 | low2, high1 | low2, high1 | high2, low1 | high2)])

    def gates(self, codes: np.ndarray, deepest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each rule passes, its support rate and its concentration. codes: rules x slots, rows of hits, -1 for an empty slot; the first slot is filled."""
        p, lines = self.p, self.hits[codes[:, 0]]
        for j in range(1, codes.shape[1]):
            some = codes[:, j] >= 0
            lines[some] &= self.hits[codes[some, j]]
        quads = np.stack([_count(lines & q) for q in self.quadrants], 1)
        n, top = quads.sum(1), quads.argmax(1)
        own = np.arange(len(codes))
        concentration, rate = quads[own, top] / np.maximum(n, 1), n / (self.n - deepest - p.future_span)
        calm = _count(lines & self.beyond[top]) == 0
        return (n > 0) & (concentration >= p.min_concentration) & calm & (rate >= p.min_support), rate, concentration


class Judged(dict):
    """Statistics of a rule: what the gates told, and all others once one of them is asked for."""

    def __init__(self, panel: Panel, rule: tuple, **told: float):
        super().__init__(told)
        self.panel, self.rule = panel, rule

    def __missing__(self, name: str):
        self.update(rule_statistics(self.panel.flags, self.panel.x, self.rule, self.panel.p))
        return self[name]


def paths(panel: Panel, to: np.ndarray, attr: np.ndarray, delay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rules that the graphs spell, in order of individual, start and depth: individuals, and codes (see Panel.gates) in ascending order.

    A walk ends where fewer rows are left than the least support asks of the deepest rule. An attribute met again takes its last delay.
    """
    p, lags = panel.p, panel.p.max_delay + 1
    walks = np.arange(len(to) * p.start_nodes)
    who, node = walks // p.start_nodes, to[:, : p.start_nodes].ravel()
    least = p.min_support * (panel.n - p.max_delay - p.future_span)
    slots = np.full((len(walks), p.max_depth), -1, np.int64)
    hit, order, spelled = None, [], []
    for depth in range(p.max_depth):
        a, code = attr[who, node], attr[who, node] * lags + delay[who, node]
        hit = panel.hits[code] if hit is None else hit & panel.hits[code]
        alive = _count(hit & panel.known) >= max(1.0, least)
        walks, who, node, hit, slots, a, code = (v[alive] for v in (walks, who, node, hit, slots, a, code))
        if not len(walks):
            break
        again = (slots // lags == a[:, None]) & (slots >= 0)
        slots = np.where(again, code[:, None], slots)
        fresh = ~again.any(1)
        slots[fresh, (slots[fresh] >= 0).sum(1)] = code[fresh]
        spelled.append(slots.copy())
        order.append(walks * p.max_depth + depth)
        node = to[who, node]
    if not spelled:
        return np.zeros(0, np.int64), slots[:0]
    order, codes = np.concatenate(order), np.concatenate(spelled)
    codes = np.where(codes < 0, np.iinfo(np.int64).max, codes)
    codes.sort(1)
    codes[codes == np.iinfo(np.int64).max] = -1
    place = np.argsort(order)
    return order[place] // (p.max_depth * p.start_nodes), codes[place]


class Usage:
    """How often found rules use each value of a gene, over the last generations; each begins with a base, and one in every `history` with the bonus."""

    def __init__(self, size: int, first: list[int], base: int, bonus: int, every: int):
        self.windows = deque([np.full(size, v, np.int64) for v in first], maxlen=len(first))
        self.size, self.base, self.bonus, self.every = size, base, bonus, every

    def add(self, value: int, times: int = 1) -> None:
        self.windows[0][value] += times

    def weights(self, generation: int) -> np.ndarray:
        """Of the windows so far; then the next one opens."""
        total = sum(self.windows)
        self.windows.appendleft(np.full(self.size, self.bonus if generation % self.every == 0 else self.base, np.int64))
        return total


def evolve(flags: np.ndarray, names: list[str], x: np.ndarray, p: MiningParams, seed: int, credit=concentration_fitness) -> tuple[list[dict], list[dict]]:
    """Rules in order of discovery, and a log line per generation."""
    r = np.random.default_rng(seed)
    size, starts, lags = p.individuals, p.start_nodes, p.max_delay + 1
    all_nodes = starts + p.judgement_nodes
    to = r.integers(starts, all_nodes, (size, all_nodes))
    attr = r.integers(0, len(names), (size, all_nodes))
    delay = r.integers(0, lags, (size, all_nodes))
    panel = Panel(flags, x, p)
    known: dict[bytes, tuple | None] = {}
    found: dict[tuple, dict] = {}
    delays = Usage(lags, [1] * p.history, 1, p.refresh_bonus, p.history)
    attributes = Usage(len(names), [1] + [0] * (p.history - 1), 0, 1, p.history)
    log = []

    def judge(codes: np.ndarray, keys: list[bytes]) -> None:
        deepest = np.where(codes >= 0, codes % lags, 0).max(1)
        for code, key, ok, rate, concentration in zip(codes.tolist(), keys, *(v.tolist() for v in panel.gates(codes, deepest))):
            if ok:
                rule = tuple((c // lags, c % lags) for c in code if c >= 0)
                s = Judged(panel, rule, support_rate=rate, concentration=concentration)
                known[key] = (rule, s, credit(len(rule), s))
            else:
                known[key] = None

    for generation in range(p.generations):
        fitness = -1e-5 * np.arange(size)
        who, codes = paths(panel, to, attr, delay)
        if len(who):
            lines = np.ascontiguousarray(np.column_stack([who, codes]))
            # One line per individual and rule, in order of the first.
            _, first = np.unique(lines.view(f"V{lines.itemsize * lines.shape[1]}").ravel(), return_index=True)
            first.sort()
            who, codes = who[first], np.ascontiguousarray(codes[first])
            keys = codes.view(f"V{codes.itemsize * codes.shape[1]}").ravel().tolist()
            unknown = {key: i for i, key in enumerate(keys) if key not in known}
            if unknown:
                judge(codes[list(unknown.values())], list(unknown))
            for i, key in zip(who.tolist(), keys):
                if (got := known[key]) is None:
                    continue
                rule, s, worth = got
                fitness[i] += worth
                name = rule if p.dedupe_by_delay else tuple(a for a, _ in rule)
                if name not in found and len(found) < p.max_rules_per_trial:
                    fitness[i] += NEW_RULE
                    s["x1_sigma"]  # all of its statistics
                    found[name] = s | {"rule": rule, "generation": generation, "seq": len(found), "k": len(rule)}
                    good = s["support_rate"] >= p.high_support_multiplier * p.min_support or max(s["x1_sigma"], s["x2_sigma"]) <= p.low_variance_multiplier * p.max_sigma
                    for a, d in rule:
                        attributes.add(a)
                        delays.add(d, 1 + p.refresh_bonus * good)
        log.append({"generation": generation, "rules": len(found), "best_fitness": float(fitness.max()), "mean_fitness": float(fitness.mean())})
        if len(found) >= p.max_rules_per_trial:
            break
        delay_weight, attr_weight = delays.weights(generation), attributes.weights(generation)
        best = np.argsort(-fitness, kind="stable")[: p.elite]
        chosen = np.tile(best, p.elite_copies)[:size]
        to, attr, delay = to[chosen].copy(), attr[chosen].copy(), delay[chosen].copy()
        for i in range(p.crossover_pairs):
            at = r.integers(starts, all_nodes, p.crossover_points)
            place, times = np.unique(at, return_counts=True)
            at = place[times % 2 == 1]  # a point drawn twice is exchanged and exchanged back
            for gene in (to, attr, delay):
                gene[[i, i + p.crossover_pairs], at[:, None]] = gene[[i + p.crossover_pairs, i], at[:, None]]
        to[:, :starts] = r.integers(starts, all_nodes, (size, starts))
        second, third, later = slice(p.elite, 2 * p.elite), slice(2 * p.elite, size), slice(p.elite, size)
        one_in = lambda gene: r.integers(0, p.mutation_one_in, gene[:, starts:].shape) == 0
        m = one_in(to[second])
        to[second, starts:] = np.where(m, r.integers(starts, all_nodes, m.shape), to[second, starts:])
        m = one_in(delay[later])
        delay[later, starts:] = np.where(m, _roulette(r, delay_weight, m.shape), delay[later, starts:])
        m = one_in(attr[third])
        attr[third, starts:] = np.where(m, _roulette(r, attr_weight, m.shape), attr[third, starts:])
    return list(found.values()), log


def _roulette(r: np.random.Generator, weight: np.ndarray, shape: tuple) -> np.ndarray:
    """Drawn in proportion to weight, evenly if there is none."""
    total = weight.sum()
    return np.searchsorted(np.cumsum(weight), r.integers(0, total, shape), side="right") if total > 0 else r.integers(0, len(weight), shape)


#: What a task's panel may take: its bitmaps, once per delay, must fit a worker's memory beside Spark. Larger panels are mined by levels (mining.mined).
MOST_PANEL_BYTES = 256 << 20


def packed_panel(items: DataFrame) -> list[tuple[str, bytes]]:
    """Each attribute's rows as a bitmap. Their total is checked before any of it comes to the driver."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame["i"].to_numpy(np.int64)
        bits = np.zeros(int(rows.max()) + 1, bool)
        bits[rows] = True
        return pd.DataFrame({"attr": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    total = items.groupBy("attr").agg(((F.max("i") + 8) / 8).alias("b")).agg(F.sum("b")).first()[0] or 0
    if total > MOST_PANEL_BYTES:
        raise ValueError(f"a panel of {total:.0f} bytes is beyond one task's memory; mine it by levels")
    return sorted((r.attr, bytes(r.bits)) for r in items.select("attr", "i").groupBy("attr").applyInPandas(pack, "attr string, bits binary").collect())


def mine(items: DataFrame, series: DataFrame, p: MiningParams, log: bool = False, credit=concentration_fitness) -> DataFrame:
    """Rules of every target in series, for p.trials trials each (or the log of generations).

    A task's input is the target's values, as many as its calendar has steps; the panel's bitmaps go to each executor once, by a broadcast of checked size.
    """
    shared = series.sparkSession.sparkContext.broadcast(packed_panel(items))
    values = series.groupBy("inst").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x0").alias("x")))).alias("values"))
    tasks = values.select("inst", "values", F.explode(F.sequence(F.lit(0), F.lit(p.trials - 1))).alias("trial"))
    settings = asdict(p)

    def run(frames):
        q = MiningParams(**settings)
        names = [a for a, _ in shared.value]
        for frame in frames:
            for row in frame.itertuples():
                x = np.array([np.nan if v["x"] is None else v["x"] for v in row.values], float)
                flags = np.zeros((len(names), len(x)), bool)
                for j, (_, bits) in enumerate(shared.value):
                    own = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(x)]
                    flags[j, : len(own)] = own
                rules, lines = evolve(flags, names, x, q, zlib.crc32(f"{row.inst}|{row.trial}".encode()), credit) if names else ([], [])
                if log:
                    yield pd.DataFrame([{"inst": row.inst, "trial": row.trial} | s for s in lines], columns=[c.split()[0] for c in LOG.split(", ")])
                else:
                    for s in rules:
                        s |= {"inst": row.inst, "trial": row.trial, "high_support": s["support_rate"] >= q.high_support_multiplier * q.min_support, "low_variance": max(s["x1_sigma"], s["x2_sigma"]) <= q.low_variance_multiplier * q.max_sigma, "rule": " & ".join(f"{names[a]}(t-{d})" for a, d in s["rule"])}
                    yield pd.DataFrame(rules, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return tasks.repartition(tasks_at_once(tasks, p)).mapInPandas(run, LOG if log else SCHEMA)


def tasks_at_once(tasks: DataFrame, p: MiningParams) -> int:
    """One partition for each search, up to 10,000; more share them."""
    return max(1, min(10_000, tasks.select("inst").distinct().count() * p.trials))


def merged_pool(rules: DataFrame) -> DataFrame:
    """One row per target and rule, the first found over all trials; delays count. The rules are written out first, as they are read twice."""
    rules = stored(rules)
    first = rules.groupBy("inst", "rule").agg(F.min(F.struct("trial", "seq")).alias("f"))
    return rules.join(first.select("inst", "rule", F.col("f.trial").alias("trial"), F.col("f.seq").alias("seq")), ["inst", "rule", "trial", "seq"], "left_semi")


def trial_statistics(rules: DataFrame) -> DataFrame:
    """Rules, well supported and narrow rules of each trial, and running totals."""
    got = rules.groupBy("inst", "trial").agg(F.count(F.lit(1)).alias("rules"), F.count_if("high_support").alias("high_support"), F.count_if("low_variance").alias("low_variance"))
    w = Window.partitionBy("inst").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return got.select("*", F.sum("rules").over(w).alias("total_rules"), F.sum("high_support").over(w).alias("total_high_support"), F.sum("low_variance").over(w).alias("total_low_variance"))
