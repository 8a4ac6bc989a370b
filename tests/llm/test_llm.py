"""The operators of the llm problems: against brute force, exact round trips and held-out accuracy."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lagweave.functions.keys import encode_key
from lagweave.llm import languages, queries, sql
from lagweave.llm.copies import collapse_copies, label_copies
from lagweave.llm.packing import OpenBins, pack_items
from lagweave.llm.percentiles import day_summary, exact_percentiles, merged_percentiles
from lagweave.llm.tokens import byte_table, count_tokens, decode_ids, encode_texts
from lagweave.llm.top_items import top_items

SMALL = "/root/testdata/sf0.001"
SLOTS = [f"attr{i}" for i in range(1, 4)]


@pytest.mark.parametrize("name", list(sql.ORACLE))
def test_query_equals_sql(against_sql, name):
    against_sql(queries.QUERIES[name], sql.ORACLE[name])


# Problem 2


def written(r, condition):
    name, kind, d = condition
    return r.choice([f"{name}_{kind}(t-{d})", f" {name.lower()}-{kind.upper()} T_{d}\r\n", f"<{name}/{kind}{{t−{d}}}>", f"「{name}.{kind}」t{d}　"])


@pytest.mark.parametrize("bits", [56, 1])
def test_copies_against_brute_force(spark, bits):
    r = random.Random(4)
    pool = [(n, k, d) for n in ("EURUSD", "GBPJPY") for k in ("Up", "Down") for d in range(3)]
    rows = []
    for i in range(600):
        conds = r.sample(pool, r.randrange(0, 4)) if i > 150 else [pool[0]]
        cells = [written(r, c) for c in conds] + [r.choice(["0", "-", " ", "", None, "(0)"]) for _ in range(3 - len(conds))]
        if len(conds) == 2 and r.random() < 0.3:
            cells = [cells[0], cells[1], written(r, conds[0])]  # the same condition twice
        r.shuffle(cells)
        rows.append((i * 3 % 601, r.choice(["p", "q", "P", None]), *cells, frozenset(conds), "x"))
    schema = "rule_id long, pool_id string, attr1 string, attr2 string, attr3 string, first string, id string"
    df = spark.createDataFrame([(*x[:5], "clash", "clash") for x in rows], schema)
    first = {}
    for x in sorted(rows, key=lambda x: x[0]):
        first.setdefault((x[1], x[5]), x[0])
    got = {g.rule_id: g for g in label_copies(df, SLOTS, "pool_id", "rule_id", bits, least_hot=50).collect()}
    assert len(got) == len(rows)
    for x in rows:
        assert got[x[0]].first == first[x[1], x[5]] and got[x[0]].pool_id == x[1]
    assert {c.rule_id for c in collapse_copies(df, SLOTS, "pool_id", "rule_id").collect()} == set(first.values())


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([], "rule_id long, pool_id string, attr1 string, attr2 string, attr3 string")
    assert label_copies(df, SLOTS, "pool_id", "rule_id").count() == 0
    df = spark.createDataFrame([(None, "p", "A", None, None), (1, "p", "A" * 100_000, None, None), (2, "p", None, None, "a" * 100_000)], df.schema)
    assert sorted((g.rule_id, g.first) for g in label_copies(df, SLOTS, "pool_id", "rule_id").collect()) == [(1, 1), (2, 1)]


# Problem 4


@pytest.mark.parametrize("batch", [3, 10_000])
def test_top_items_against_brute_force(spark, batch):
    r = random.Random(1)
    rows = [(i, r.choice(["hot", "hot", "a", "b", "c", None, ""]), r.choice([1.0, 2.0, -1.0, 0.0, -0.0, None]), r.choice([None, 0.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, _group_key string, score double, tie double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = top_items(df, "_group_key", [F.desc("score"), F.desc_nulls_last("tie"), F.asc("id")], 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = set()
    for g in {x[1] for x in rows}:
        own = sorted((x for x in rows if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0.0), x[3] is None, x[0]))
        want |= {(g, x[0]) for x in own[:5]}
    assert {(g["_group_key"], g.id) for g in got} == want and len(got) == len(want)
    assert top_items(df.limit(0), "_group_key", [F.asc("id")], 5).count() == 0 and top_items(df, "_group_key", [F.asc("id")], 0).count() == 0


# Problem 6


@pytest.mark.parametrize("splits,few", [(2, 0), (64, 50_000)])
def test_percentiles_against_brute_force(spark, splits, few):
    r = np.random.default_rng(5)
    data = {"n": r.normal(0, 3, 700), "two": np.round(r.normal(0, 1, 400), 2), "same": np.repeat(3.5, 50), "one": np.array([-7.0]), "wide": np.array([-1.7e308, -1e-300, 0.0, 5e-324, 1e300, 1.7e308]), "close": 1 + np.arange(40) * 2.0**-50}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [(k, v) for k in ("n", None) for v in (None, math.nan, math.inf)]
    df = spark.createDataFrame(rows, "s string, x double").select(encode_key(F.col("s")).alias("k"), "x")
    ps = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {(q.k[1:], q.p): q for q in exact_percentiles(df, ps, splits, few).collect()}
    assert len(got) == len(data) * len(ps)
    for (k, p), q in got.items():
        v = np.sort(data[k])
        place = (len(v) - 1) * p
        assert (q.n, q.lower_value, q.upper_value) == (len(v), v[math.floor(place)], v[math.ceil(place)])
    assert exact_percentiles(df.where("k = ''"), ps).count() == 0
    with pytest.raises(ValueError):
        exact_percentiles(df, [1.5])


def test_day_summaries_merge_within_their_bound(spark):
    r = np.random.default_rng(6)
    v = r.lognormal(0, 2, 3000) * r.choice([-1, 1], 3000)
    df = spark.createDataFrame([("=a", float(x), i % 5) for i, x in enumerate(v)], "k string, x double, day int")
    parts = day_summary(df.where("day < 2"), "day").unionByName(day_summary(df.where("day >= 2"), "day"))
    for q in merged_percentiles(parts, [0.01, 0.3, 0.5, 0.99]).collect():
        true = np.sort(v)[math.floor((len(v) - 1) * q.p)]
        assert q.lower <= true <= q.upper and abs(q.upper - q.lower) <= 0.0111 * max(abs(q.upper), abs(q.lower))


# Problem 7

TEXTS = ["", None, " ", "Hello  world", "<|endoftext|> is text", "naïve ÄÖ 日本語 🙂👩‍💻", "\x00​\n\n\ttabs", "é", "a" * 60_000, "数" * 20_000, "it's 3.14%"]


def test_tokens_round_trip_and_spans(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS + TEXTS[:2])] + [(None, "x", "")], "doc_id long, text string, ids string")
    got = encode_texts(df, spans=True).collect()
    assert len(got) == len(TEXTS) + 3
    import base64

    import tiktoken

    from lagweave.llm.tokens import FOLDER, PATTERN

    with open(os.path.join(FOLDER, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    for r in got:
        if r.doc_id is None:
            continue
        t = (TEXTS + TEXTS[:2])[r.doc_id] or ""
        assert r.ids == other.encode_ordinary(t)
        assert len(r.starts) == len(r.ends) == len(r.ids)
        if t:
            assert r.starts[0] == 0 and r.ends[-1] == len(t)
            assert list(zip(r.starts, r.ends)) == [tuple(o) for o in lib.encode(t, add_special_tokens=False).offsets]
    back = {r.doc_id: r.text for r in decode_ids(encode_texts(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    split = decode_ids(spark.createDataFrame([(1, [ranks[b"\xf0\x9f"]]), (2, None)], "doc_id long, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in split} == {1: "�", 2: None}


def test_byte_table_is_a_bijection():
    assert sorted(byte_table().values()) == list(range(256))


def test_other_tokenizers_count(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.tokenizer): r["size"] for r in count_tokens(df, ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"]).collect()}
    assert all(n == 0 for (d, _), n in got.items() if d == 2) and all(n >= 2 for (d, _), n in got.items() if d == 1) and len(got) == 8
    with pytest.raises(FileNotFoundError):
        from lagweave.llm.tokens import encoder

        encoder("/opt/tokenizers", "none")


# Problem 8


@given(st.lists(st.integers(1, 20), max_size=200), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_open_bins_against_a_plain_search(sizes, limit):
    bins, free, order = OpenBins(20, limit), {}, []
    made = 0
    for s in sizes:
        fit = [b for b in order if free[b] >= s]
        if fit:
            least = min(free[b] for b in fit)
            at = [b for b in order if free[b] == least][-1]
            order.remove(at)
        else:
            if s < 20 and len(order) == limit:
                least = min(free[b] for b in order)
                order.remove([b for b in order if free[b] == least][-1])
            at, free[made] = made, 20
            made += 1
        free[at] -= s
        if free[at]:
            order.append(at)
        assert bins.place(s) == at and bins.open == len(order) <= limit


def test_packing_keeps_the_rules(spark):
    r = random.Random(2)
    items = [(p, i, r.choice([0, None, 1, 5, 37, 99, 100, 101, 250, r.randrange(1, 60)]), 100 * p) for p in (1, 2) for i in range(800)]
    items += items[:5] + [(1, None, 30, 100), (1, 5000, 12_345, 100), (3, 1, 10, None), (3, 2, 10, 0)]
    df = spark.createDataFrame(items, "pack_id int, item_id long, size long, capacity long")
    got = pack_items(df, open_bins=8, per_bucket=200).collect()
    filled, rooms, pieces = {}, {}, {}
    for g in got:
        rooms[g.pack_id, g.item_id] = rooms.get((g.pack_id, g.item_id), 0) + g.room
        pieces.setdefault((g.pack_id, g.item_id), []).append((g.piece, g.room))
        if g.container:
            filled[g.pack_id, g.container] = filled.get((g.pack_id, g.container), 0) + g.room
        else:
            assert g.room == 0 or g.pack_id == 3
    want = {}
    for p, i, s, _ in items:
        want[p, i] = want.get((p, i), 0) + (s or 0)
    assert rooms == want
    assert all(v <= 100 * p for (p, _), v in filled.items())
    for (p, i), own in pieces.items():
        if i is not None and i >= 5 and want[p, i] <= 100 * p and p < 3:
            assert len(own) == 1
    for p in (1, 2):
        used = [v for (q, _), v in filled.items() if q == p]
        assert sum(used) / (len(used) * 100 * p) > 0.9
    again = pack_items(df.repartition(9), open_bins=8, per_bucket=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert pack_items(df.limit(0)).count() == 0


# Problem 9


@pytest.fixture(scope="module")
def net(spark):
    ref = [tuple(r) for r in spark.read.parquet(f"{SMALL}/lang_reference.parquet").where("ref_id % 4 <> 0").select("lang", "text").collect()]
    return queries._fit_in_task(spark, ref, [])


def test_held_out_accuracy(spark, net):
    held = [tuple(r) for r in spark.read.parquet(f"{SMALL}/lang_reference.parquet").where("ref_id % 4 = 0").select("lang", "text").collect()]
    right = sum(net.labels[int(j[0][3].argmax())] == lang for (lang, _), j in zip(held, languages.judge(net, [t for _, t in held])))
    assert right / len(held) >= 0.97


def test_gradients_are_right():
    net = languages.ByteNet(["a", "b"])
    r = np.random.default_rng(0)
    codes, target = r.integers(0, 256, (3, languages.WINDOW)).astype(np.int16), np.eye(2)[[0, 1, 0]]
    loss = lambda: -float((net.log_probabilities(codes) * target).sum(1).mean())
    for p in net.parameters():  # in double, so that differences are precise
        p.dtype
    net.embed, net.out, net.shift = (a.astype(float) for a in (net.embed, net.out, net.shift))
    net.filters, net.bias = [f.astype(float) for f in net.filters], [b.astype(float) for b in net.bias]
    grads = net.gradients(codes, target)
    for p, g in zip(net.parameters(), grads):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        keep, h = p[at], 1e-6
        p[at] = keep + h
        up = loss()
        p[at] = keep - h
        down = loss()
        p[at] = keep
        assert (up - down) / (2 * h) == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_segments_cover_mixed_texts(spark, net):
    texts = [
        "The council opens the road today. Der Markt liest den Bericht heute. Die Bank prüft den Vertrag.", None, "", " \n", "12.5 %!! &nbsp; <b> 0x1F4C8 %20", "The bank repairs the bridge («das Schiff»).",
        "Банк читает отчёт сегодня。市場は今日価格を確認する。", "The harbour reads the price today. " * 3_000, "The market falls by 9.0 percent today. La maestra abre la ventana por la mañ",
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in languages.detect_languages(df, net).collect()}
    kinds = lambda i: [s.lang for s in got[i].segments]
    assert kinds(0) == ["en", "de"] and got[0].segments[1].sentences == 2 and got[0].lang == "de"
    for i in (1, 2, 3, 4):
        assert got[i].lang is None and got[i].confidence is None and got[i].segments == []
    assert kinds(5) == ["en"] and kinds(6) == ["ru", "ja"] and kinds(8) == ["en", "es"]
    assert kinds(7) == ["en"] and got[7].segments[0].sentences == 3_000 and got[7].segments[0].end == len(texts[7]) - 1
    assert all(0 < s.confidence <= 1 for r in got.values() for s in r.segments)
    found = {(r.doc_id, r.found_lang) for r in languages.other_languages(languages.detect_languages(df, net), df.withColumn("lang", F.lit(" EN-GB "))).collect()}
    assert found == {(0, "de"), (6, "ru"), (6, "ja"), (8, "es")}
    assert languages.detect_languages(df.limit(0), net).count() == 0


def test_windows_cover_every_byte():
    raws = [b"", b"ab", b"x" * 96, bytes(range(97)), bytes(i % 251 for i in range(1_000))]
    codes, n = languages.windows(raws)
    assert n.tolist() == [1, 1, 1, 2, 11] and len(codes) == 16
    at = 0
    for raw, k in zip(raws, n):
        seen = {}
        for j in range(k):
            for i, c in enumerate(codes[at + j]):
                if c != languages.PADDING:
                    seen[j * languages.STRIDE + i] = c
        assert [seen[i] for i in range(len(raw))] == list(raw) and len(seen) == len(raw)
        at += k


def test_batches_leave_probabilities_as_they_are(net):
    raws = [b"", b"the market", "рынок".encode(), b"a" * 300, b"the market"]
    together = languages.log_probabilities(net, raws)
    for raw, logs in zip(raws, together):
        codes, _ = languages.windows([raw])
        assert logs == pytest.approx(net.log_probabilities(codes).mean(0), abs=1e-4)


@pytest.mark.parametrize("label,want", [("en", "en"), (" EN_us ", "en"), ("pt-BR", "pt"), ("ru-Cyrl", "ru"), ("", None), ("  ", None), ("und", None), ("UND", None), (None, None), ("\tde\n", "de")])
def test_labels(spark, label, want):
    assert spark.createDataFrame([(label,)], "l string").select(languages.label_language(F.col("l"))).first()[0] == want


def test_documents_found_agree_with_their_vocabulary(spark):
    """Each language of the tables has words of its own: a sentence with words of one language alone is of that language."""
    ref = duckdb.connect().execute(f"SELECT lang, lower(text) FROM '{SMALL}/lang_reference.parquet'").fetchall()
    words = {}
    for lang, text in ref:
        for w in languages.WORD.sub(lambda m: m[0], text).replace(".", " ").replace(",", " ").split():
            words.setdefault(w, set()).add(lang)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    model = queries.language_model(spark.read.parquet(f"{SMALL}/lang_reference.parquet"), spark.read.parquet(f"{SMALL}/documents.parquet"))
    right = total = 0
    for doc, own in zip(docs, languages.judge(model, [d.text for d in docs])):
        for a, b, _, logs in own:
            votes = [next(iter(words[w])) for w in languages.fold(languages.core(doc.text[a:b])).replace(".", " ").replace(",", " ").split() if len(words.get(w, ())) == 1]
            if len(votes) >= 3 and len(set(votes)) == 1:
                total += 1
                right += model.labels[int(logs.argmax())] == votes[0]
    assert total > 100 and right / total >= 0.99
