"""Languages of documents and of their stretches, by a byte convolutional network.

Method. Text is lower-cased and compatibility-normalized, its bytes embedded; filters of several widths run over a window of
fixed length, each keeps its maximum, and a softmax over these gives the language. Trained in numpy on labelled sentences,
with windows cut at random places, made-up names and numbers put in, and labels of half the size for cut-off sentences; seeded, so that the
same sentences give the same model. Windows of whole texts go through it in batches; a sentence has the mean of its windows'
log-probabilities, neighbouring sentences of one language form a stretch, a document has the language of most of its letters.

Scale. The model is some 15,000 numbers in the task's closure; texts go through Arrow batches row for row, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WIDTHS, FILTERS, DEPTH = (2, 3, 4, 5), 32, 12
#: Windows overlap by what the widest filter spans, so that no run of bytes is lost at their ends.
WINDOW, BATCH = 96, 256
STRIDE, PADDING = WINDOW - max(WIDTHS) + 1, 256
#: A sentence ends at a mark followed by blanks or the end; the ideographic ones need no blank.
ENDS = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？]+[」』）]*")
WORD = re.compile(r"[^\W\d_]")
#: What is no language: tags, entities, escapes, addresses, numbers with letters; and asides in brackets.
MARKUP = re.compile(r"<[^<>\s][^<>]{0,80}>|&#?\w{1,10};|\\[a-zA-Z](?![a-z])|\b(?:https?://|www\.)\S+|\S+@\S+\.\S+|%[0-9A-Fa-f]{2}|\b0x[0-9A-Fa-f]+\b|\b[Uu]\+[0-9A-Fa-f]{4,6}\b")
ASIDE = re.compile(r"\([^()]{1,80}\)|（[^（）]{1,80}）|\[[^\[\]]{1,80}\]|«[^«»]{1,80}»")

#: One of these stands in any markup, one of those at the start of any aside.
HINTS, OPENS = ("<", "&", "\\", "@", "%", "://", "www.", "0x", "U+", "u+"), "([（«"


def fold(text: str) -> str:
    """What the network reads: compatibility forms composed, lower case, runs of blanks as one."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower().split())


def blanked(text: str) -> str:
    """The text with markup as blanks, character for character."""
    return MARKUP.sub(lambda m: " " * len(m[0]), text) if any(h in text for h in HINTS) else text


def core(sentence: str) -> str:
    """The sentence without asides, unless they are most of it: a few foreign words don't make it foreign."""
    if not any(c in sentence for c in OPENS):
        return sentence
    rest = ASIDE.sub(" ", sentence)
    return rest if len(WORD.findall(rest)) * 2 >= len(WORD.findall(sentence)) else sentence


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences that hold at least one letter; one cut off at the end counts."""
    out, start = [], 0
    for end in [*(m.end() for m in ENDS.finditer(text)), len(text)]:
        if end > start and WORD.search(text, start, end):
            out.append((start, end))
        start = max(start, end)
    return out


class ByteNet:
    """Embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.embed = r.normal(0, 0.3, (PADDING + 1, DEPTH)).astype(np.float32)
        self.embed[PADDING] = 0
        self.filters = [r.normal(0, (2 / (w * DEPTH)) ** 0.5, (w * DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.shift = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.shift]

    def _responses(self, codes: np.ndarray) -> np.ndarray:
        """Of every filter at every place, windows x places x filters: all widths as one product, narrow filters ending in zeros."""
        wide = max(WIDTHS)
        f = np.zeros((wide * DEPTH, FILTERS * len(WIDTHS)), self.embed.dtype)
        for i, (w, own) in enumerate(zip(WIDTHS, self.filters)):
            f[: w * DEPTH, i * FILTERS : (i + 1) * FILTERS] = own
        e = self.embed[np.pad(codes, ((0, 0), (0, wide - 1)), constant_values=PADDING)]
        spans = np.lib.stride_tricks.as_strided(e, (*codes.shape, wide * DEPTH), e.strides)
        return (spans.reshape(-1, wide * DEPTH) @ f).reshape(*codes.shape, -1)

    def _top(self, pooled: np.ndarray) -> np.ndarray:
        return pooled + np.concatenate(self.bias)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        z = np.maximum(self._top(self._responses(codes).max(1)), 0) @ self.out + self.shift
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of parameters()."""
        r = self._responses(codes)
        at = r.argmax(1)
        p = self._top(np.take_along_axis(r, at[:, None], 1)[:, 0])
        codes = np.pad(codes, ((0, 0), (0, max(WIDTHS) - 1)), constant_values=PADDING)
        h = np.maximum(p, 0)
        z = h @ self.out + self.shift
        q = np.exp(z - z.max(1, keepdims=True))
        d = (q / q.sum(1, keepdims=True) - target) / len(codes)
        dh = (d @ self.out.T) * (p > 0)
        dfilters, dbias, read, push = [], [], [], []
        rows = np.arange(len(codes))[:, None, None]
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            c = codes[rows, at[:, i * FILTERS : (i + 1) * FILTERS, None] + np.arange(w)]  # the bytes at each filter's maximum
            dfilters.append(np.matmul(g.T[:, None], self.embed[c].reshape(len(codes), FILTERS, -1).transpose(1, 0, 2))[:, 0].T)
            dbias.append(g.sum(0))
            read.append(c.ravel())
            push.append((g[:, :, None] * f.T[None]).reshape(-1, DEPTH))
        read, push = np.concatenate(read), np.concatenate(push)
        order = np.argsort(read, kind="stable")
        values, starts = np.unique(read[order], return_index=True)
        dembed = np.zeros_like(self.embed)
        dembed[values] = np.add.reduceat(push[order], starts)
        dembed[PADDING] = 0
        return [dembed, *dfilters, *dbias, h.T @ d, d.sum(0)]


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows over all bytes, the last of each text padded, and how many each text has."""
    sizes = np.array([len(r) for r in raws])
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    first = np.cumsum(n) - n
    ends = np.cumsum(sizes)
    start = np.repeat(ends - sizes, n) + (np.arange(n.sum()) - np.repeat(first, n)) * STRIDE
    at = start[:, None] + np.arange(WINDOW)
    buffer = np.frombuffer(b"".join(raws) + b" ", np.uint8).astype(np.int16)  # a byte has no place for the padding
    inside = at < np.repeat(ends, n)[:, None]
    return np.where(inside, buffer[np.where(inside, at, 0)], np.int16(PADDING)), n


def train(labelled: list[tuple[str, str]], steps: int = 500, batch: int = 128, seed: int = 7, net: ByteNet | None = None) -> ByteNet:
    """A network from (language, sentence) pairs, languages drawn evenly; net: one to go on with."""
    r = np.random.default_rng(seed)
    net = net or ByteNet(sorted({lang for lang, _ in labelled}), seed)
    by = [[fold(s) for lang, s in labelled if lang == x] for x in net.labels]
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    vowels, others = "aeiou", "bcdfghklmnprstvxz"

    def name() -> str:
        return "".join(r.choice(list(others)) + r.choice(list(vowels)) for _ in range(r.integers(2, 5)))

    def sample(which: int) -> np.ndarray:
        own = by[which]
        text = own[r.integers(len(own))]
        if r.random() < 0.3:
            text += " " + own[r.integers(len(own))]
        if r.random() < 0.15:
            words = text.split(" ")
            words.insert(int(r.integers(len(words) + 1)), name() if r.random() < 0.7 else str(r.integers(1000)))
            text = " ".join(words)
        raw = text.encode()
        kind = r.random()
        if kind < 0.3:  # cut off, down to a few letters
            raw = raw[: int(r.integers(6, max(7, len(raw))))]
        elif kind < 0.45:
            start = int(r.integers(0, max(1, len(raw) - 24)))
            raw = raw[start : start + int(r.integers(16, WINDOW + 1))]
        out = np.full(WINDOW, PADDING, np.int16)
        raw = np.frombuffer(raw[:WINDOW], np.uint8)
        out[: len(raw)] = raw
        return out

    eye = np.eye(len(net.labels), dtype=np.float32) * 0.98 + 0.02 / len(net.labels)
    for step in range(1, steps + 1):
        which = r.integers(len(net.labels), size=batch)
        grads = net.gradients(np.stack([sample(w) for w in which]), eye[which])
        rate = 0.004 * min(1, step / 50) * (1 - step / (steps + 1)) ** 0.5
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(clean: list[tuple[str, str]], texts: list[tuple[str, str]], steps: tuple[int, int] = (400, 700), sure: float = 0.9) -> ByteNet:
    """A network from clean labelled sentences, then also from those sentences of loosely labelled texts on which the first fit and the text's label agree."""
    net = train(clean, steps[0])
    agreed = []
    for (lang, text), own in zip(texts, judge(net, [t for _, t in texts])):
        for a, b, _, logs in own:
            best = int(logs.argmax())
            if net.labels[best] == lang and np.exp(logs[best] - np.logaddexp.reduce(logs)) >= sure:
                agreed.append((lang, core(blanked(text)[a:b])))
    return train(clean + agreed, steps[1], net=net)


def log_probabilities(net: ByteNet, raws: list[bytes]) -> np.ndarray:
    """Mean over the windows of each text. Equal texts are judged once; windows go through the network by their filling, so that a batch leaves out the places that are padding in all of it but one."""
    distinct = {r: i for i, r in enumerate(dict.fromkeys(raws))}
    codes, n = windows(list(distinct))
    filled = (codes != PADDING).sum(1)
    order = np.argsort(filled, kind="stable")
    logs = np.empty((len(codes), len(net.labels)))
    for i in range(0, len(order), BATCH):
        own = order[i : i + BATCH]
        logs[own] = net.log_probabilities(codes[own, : min(WINDOW, filled[own[-1]] + 1)])
    means = np.add.reduceat(logs, np.cumsum(n) - n) / n[:, None]
    return means[[distinct[r] for r in raws]]


def judge(net: ByteNet, texts: list[str | None], at_once: int = 4_096) -> list[list[tuple[int, int, int, np.ndarray]]]:
    """Per text its sentences: start, end, letters, mean log-probabilities. Some `at_once` sentences of several texts share batches."""
    out, spans, raws = [[] for _ in texts], [], []

    def flush() -> None:
        if raws:
            for (t, *span), logs in zip(spans, log_probabilities(net, raws)):
                out[t].append((*span, logs))
            spans.clear()
            raws.clear()

    for t, text in enumerate(texts):
        text = blanked(text or "")
        for a, b in sentences(text):
            piece = core(text[a:b])
            spans.append((t, a, b, sum(map(str.isalpha, piece))))
            raws.append(fold(piece).encode())
            if len(raws) >= at_once:
                flush()
    flush()
    return out


SEGMENTS = "array<struct<start:int,end:int,sentences:int,lang:string,confidence:double>>"


def detect_languages(df: DataFrame, net: ByteNet, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, lang, confidence, segments. Row for row; other columns are not read.

    segments: stretches of sentences of one language, as code points [start, end), with the mean probability of that language. lang and
    confidence: the language of most letters, and the mean probability by letters. A NULL or empty text, or one without a
    letter, has NULL lang and confidence and no segments. Repeated rows each come out.
    """
    rows = df.select(row_id, text)
    schema = StructType([rows.schema[row_id]]).simpleString()[7:-1] + f",lang:string,confidence:double,segments:{SEGMENTS}"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_024):
                batch = whole.slice(at, 1_024)
                langs, sure, segs = [], [], []
                for own in judge(net, batch.column(text).to_pylist()):
                    weight, parts = np.zeros(len(net.labels)), []
                    logs = np.array([x[3] for x in own]).reshape(len(own), len(net.labels))
                    shares = np.exp(logs - logs.max(1, initial=-np.inf, keepdims=True))
                    shares /= shares.sum(1, keepdims=True)
                    for (a, b, letters, _), p, best in zip(own, shares, shares.argmax(1).tolist() if own else []):
                        weight += p * letters
                        if parts and parts[-1][3] == best:
                            parts[-1][1], parts[-1][2], parts[-1][4] = b, parts[-1][2] + 1, parts[-1][4] + float(p[best])
                        else:
                            parts.append([a, b, 1, best, float(p[best])])
                    best = int(weight.argmax()) if own else None
                    langs.append(None if best is None else net.labels[best])
                    sure.append(None if best is None else float(weight[best] / weight.sum()))
                    segs.append([{"start": a, "end": b, "sentences": n, "lang": net.labels[i], "confidence": c / n} for a, b, n, i, c in parts])
                yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(segs, kind)], names=[row_id, "lang", "confidence", "segments"])

    return rows.mapInArrow(run, schema)


def label_language(c):
    """The language that a label names: the part before - or _, trimmed, in lower case; NULL, blank and und name none."""
    name = F.lower(F.trim(F.regexp_replace(F.split_part(F.translate(c, "_", "-"), F.lit("-"), F.lit(1)), r"^\s+|\s+$", "")))
    return F.when(~name.isin("", "und"), name)


def other_languages(detected: DataFrame, labels: DataFrame, row_id: str = "doc_id", label: str = "lang") -> DataFrame:
    """row_id, found_lang: each language of a segment that the row's label does not name. row_id must be unique."""
    own = labels.select(row_id, label_language(F.col(label)).alias("_named"))
    found = detected.select(row_id, F.explode(F.array_distinct(F.transform("segments", lambda s: s["lang"]))).alias("found_lang"))
    return found.join(own, row_id).where(~F.col("found_lang").eqNullSafe(F.col("_named"))).select(row_id, "found_lang")
