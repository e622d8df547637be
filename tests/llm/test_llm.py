"""The llm operators against brute force, exact round trips and stated bounds."""

import collections
import datetime
import math
import random

import numpy as np
import pytest
from helpers import as_rows, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from understory.llm import bpe, packing, quantiles, queries, spans

DOC = "doc_id long, text string, lang string, source string, n_chars int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in texts], DOC)


# ---------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def public():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary())


ODD = ["", " ", "\t \n", "a", "aaaaaaaa" * 40, "<|endoftext|> <s>", "naïve café é", "😀👩‍👩‍👧 x", "日本語のテキスト", "it's 'll 've", "  lead and trail  ", "\u0000​﻿", "x" * 30_000, "ab" * 9_000, "1234567890" * 50, "a\r\nb\n\n\nc", "é" * 4000]


def test_odd_texts(public, encoder):
    for t in ODD:
        assert encoder.encode(t) == public(t)
    assert encoder.encode(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n'", max_size=200))
def test_any_text(public, encoder, text):
    assert encoder.encode(text) == public(text)


def test_ids_of_documents(spark, data, public):
    d = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_documents(with_clashes(d)).collect()}
    assert got == {r.doc_id: public(r.text) if r.text else [] for r in d.collect()}
    two = bpe.encode_documents(docs(spark, [(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in two) == [(0, 0), (1, 1), (1, 1)]
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def test_queue_order():
    q = bpe.RankQueue(200_000)
    rng, left = random.Random(1), collections.defaultdict(list)
    for _ in range(3000):
        r, at = rng.choice([rng.randrange(200_000), rng.randrange(50)]), rng.randrange(10**6)
        q.push(r, at)
        left[r].append(at)
    out = []
    while (got := q.pop()) is not None:
        out.append(got)
    assert out == [(r, sorted(left[r])) for r in sorted(left)]


# ---------------------------------------------------------------- containers

def check_packed(rows, sizes, caps):
    """Nothing lost, split only where needed, no overlap, no container over its capacity. Gives the unused share."""
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece_start, r.n_tokens))
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, r.bin_capacity))
    assert set(parts) == set(sizes)
    for i, n in sizes.items():
        p = sorted(parts[i])
        assert sum(x for _, x in p) == n and (len(p) == 1 or n > max(caps)) and len(p) == max(1, -(-n // max(caps)))
        assert [a for a, _ in p] == [k * max(caps) for k in range(len(p))]
    used = total = 0
    for b in bins.values():
        b.sort()
        end = 0
        for off, n, _ in b:
            assert off == end and n > 0
            end += n
        cap = b[0][2]
        assert {c for _, _, c in b} == {cap} and cap in caps and end <= cap
        assert cap == min(c for c in caps if c >= end)  # downsized to its contents
        used, total = used + end, total + cap
    return 1 - used / total if total else 0.0, len(bins)


@pytest.mark.parametrize("caps", [(64,), (16, 32, 64)])
def test_packing(spark, caps):
    rng = np.random.default_rng(4)
    sizes = {i: int(x) for i, x in enumerate(np.r_[rng.integers(0, 200, 150), np.full(300, 21), rng.integers(1, 30, 550)])}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id long, n_tokens long, size string").repartition(5)
    rows = packing.pack(df, caps).collect()
    waste, _ = check_packed(rows, sizes, caps)
    assert waste < 0.02
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, packing.pack(df.repartition(2), caps).collect()), key=str)


def plain_best_fit(sizes, cap):
    room = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in room if r >= s]
        if fit:
            room.remove(min(fit))
            room.append(min(fit) - s)
        else:
            room.append(cap - s)
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=120), st.sampled_from([(40,), (10, 20, 40), (7, 40)]))
def test_plan_is_best_fit(items, caps):
    plan = packing.make_plan(collections.Counter(items), caps)
    size = np.array(sorted(items))
    no = np.arange(len(size)) - np.searchsorted(size, size)
    b, off, cap = plan.place(size, no)
    slots = sorted(zip(b.tolist(), off.tolist(), size.tolist(), cap.tolist(), strict=True))
    for (b0, o0, s0, c0), (b1, o1, _, c1) in zip(slots, slots[1:], strict=False):
        assert (b1 == b0 and o1 == o0 + s0 and c0 == c1) or (b1 == b0 + 1 and o1 == 0)
    assert slots[0][:2] == (0, 0) and slots[-1][0] == plan.bins - 1 and all(o + s <= c for _, o, s, c in slots)
    if len(caps) == 1:
        assert plan.bins == plain_best_fit(items, caps[0])


def test_packing_of_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    sizes = {r.doc_id: r.n for r in bpe.encode_documents(d).select("doc_id", F.size("ids").alias("n")).collect()}
    waste, bins = check_packed(queries.p9_packed(spark, data).collect(), sizes, (2048,))
    assert bins <= math.ceil(sum(sizes.values()) / 2048) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
    lone = packing.pack(spark.createDataFrame([(1, None), (2, 0)], "doc_id long, n_tokens long")).collect()
    assert {(r.doc_id, r.n_tokens, r.bin_id) for r in lone} == {(1, 0, None), (2, 0, None)}


# ---------------------------------------------------------------- percentiles

def rank_error(x, value, p):
    x, t = np.sort(x), max(math.ceil(p * len(x) - 1e-9), 1)
    a, b = np.searchsorted(x, value, "left") + 1, np.searchsorted(x, value, "right")
    return max(0, a - t, t - b)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 6), st.sampled_from([0.01, 0.05, 0.2]), st.booleans())
def test_summaries_bound_every_rank(seed, parts, eps, ties):
    rng = np.random.default_rng(seed)
    values = [rng.exponential(10, int(rng.integers(1, 900))).round(0 if ties else 6) for _ in range(parts)]
    state = [quantiles.summarise(np.zeros(len(v), int), v, 1, eps / 2) for v in values]
    tuples = [np.concatenate([s[i] for s in state]) for i in (1, 2, 3)]
    owner = np.repeat(np.arange(parts), [len(s[0]) for s in state])
    code, v, lo, hi, n = quantiles.merge(np.zeros(len(owner), int), owner, *tuples, np.array([len(x) for x in values]), 1, eps / 4)
    x = np.sort(np.concatenate(values))
    assert n[0] == len(x) and lo[0] == 1 and hi[-1] == len(x) and (np.diff(lo) >= 0).all() and (lo <= hi).all()
    a, b = np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right")
    assert ((lo <= b) & (hi >= a)).all()  # some rank of the value lies between the two
    e = quantiles._errors(code, lo, hi, 1)[0]
    assert e <= math.ceil(eps * len(x)) + parts
    for p in (0.01, 0.3, 0.5, 0.99):
        t = max(math.ceil(p * len(x) - 1e-9), 1)
        i = np.argmin(np.maximum(t - lo, hi - t))
        assert rank_error(x, v[i], p) <= e


def communities(spark, rows):
    return spark.createDataFrame(rows, "record_id long, year int, mapcode long, ecocode long, species_symbol string, age int, biomass double, written_at timestamp_ntz")


def exact_groups(df):
    groups = collections.defaultdict(list)
    for r in df.dropDuplicates(["record_id"]).collect():
        for f in ("biomass", "age"):
            if r[f] is not None and math.isfinite(r[f]):
                groups[r.species_symbol, r.ecocode, f].append(float(r[f]))
    return groups


def check_percentiles(got, groups, eps):
    assert {(r.species_symbol, r.ecocode, r.field) for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        x = np.array(groups[r.species_symbol, r.ecocode, r.field])
        assert r.n == len(x) and r.rank_error <= eps + 1 / len(x)
        for p in quantiles.POINTS:
            assert rank_error(x, r[f"p{round(100 * p):02d}"], p) <= r.rank_error * len(x) + 1e-9


def test_percentiles(spark, data):
    df = spark.read.parquet(f"{data}/output_communities.parquet").repartition(6)
    check_percentiles(quantiles.community_percentiles(with_clashes(df)).collect(), exact_groups(df), quantiles.EPS)
    keys = [*quantiles.KEYS, "field"]
    days = quantiles.day_summaries(df)
    check_percentiles(quantiles.percentiles(quantiles.combine_days(days), keys).collect(), exact_groups(df), quantiles.EPS)
    some = df.filter("written_at < timestamp'2022-01-01'")
    check_percentiles(quantiles.percentiles(quantiles.combine_days(days.filter("day < date'2022-01-01'")), keys).collect(), exact_groups(some), quantiles.EPS)


def test_percentiles_of_a_hot_group_with_ties(spark):
    rng, at = np.random.default_rng(2), datetime.datetime(2020, 1, 1)
    rows = [(i, 0, 1, None if i % 50 == 0 else 7, "AAAA" if i % 3 else None, int(rng.integers(1, 9)), float(rng.choice([1.0, 1.0, 2.0, math.nan, math.inf, rng.random()])), at + datetime.timedelta(days=i % 5)) for i in range(6000)]
    df = communities(spark, rows + rows[:100]).repartition(7)
    check_percentiles(quantiles.community_percentiles(df).collect(), exact_groups(df), quantiles.EPS)
    assert quantiles.community_percentiles(communities(spark, [])).count() == 0


# ---------------------------------------------------------------- shared spans

def plain_spans(texts, span=spans.SPAN):
    owner = collections.defaultdict(set)
    for i, t in texts:
        for k in range(len(t) - span + 1) if t else ():
            owner[t[k : k + span]].add(i)
    out = set()
    for i, t in texts:
        on = np.zeros(len(t or "") + 1, bool)
        for k in range(len(t) - span + 1) if t else ():
            if len(owner[t[k : k + span]]) > 1:
                on[k : k + span] = True
        edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(int)))
        out |= {(i, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)}
    return out


def found(spark, texts):
    return {tuple(r) for r in spans.shared_spans(docs(spark, texts).repartition(3)).collect()}


def noise(rng, n, letters="abcdefghij klmnop"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_context_leaves_room():
    assert 2 * spans.CONTEXT + spans.REACH == spans.SPAN and spans.CONTEXT == spans.context()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_match_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = [(i, noise(rng, rng.randrange(150, 900))) for i in range(40)]
    for k in range(60):  # passages of 190 to 260 characters, at borders too, some with one changed character
        a, b = rng.sample(range(40), 2)
        n = rng.choice([190, 198, 199, 200, 201, 202, 230, 260])
        src = texts[a][1]
        lo = rng.choice([0, max(0, len(src) - n), rng.randrange(max(1, len(src) - n))])
        part = src[lo : lo + n]
        if k % 5 == 0:
            m = len(part) // 2
            part = part[:m] + "#" + part[m + 1 :]
        dst = texts[b][1]
        at = rng.choice([0, len(dst), rng.randrange(len(dst))])
        texts[b] = (b, dst[:at] + part + dst[at:])
    want = plain_spans(texts)
    assert found(spark, texts) == want and len(want) > 20


@pytest.mark.parametrize("few", [1, 4, 16])
def test_cores_of_many_classes(spark, monkeypatch, few):
    """A passage of which every document holds another part; compared by characters or, beyond ``few``, by hashes."""
    monkeypatch.setattr(spans, "FEW", few)
    rng = random.Random(few)
    passage, texts = noise(rng, 420), []
    for i in range(60):
        n = rng.randrange(150, 380)
        lo = rng.randrange(420 - n)
        texts.append((i, noise(rng, rng.randrange(0, 90)) + passage[lo : lo + n] + noise(rng, rng.randrange(0, 90))))
    texts += [(100 + i, texts[40][1]) for i in range(3)] + [(200, texts[41][1] + "!" + texts[41][1])]
    assert found(spark, texts) == plain_spans(texts)


def test_shared_spans_of_runs_and_periods(spark):
    rng = random.Random(9)
    texts = [
        (1, "-" * 450), (2, noise(rng, 50) + "-" * 230 + noise(rng, 50)), (3, "ab" * 150 + "x"), (4, "ba" * 140), (5, "abc" * 120), (6, noise(rng, 300) + "abc" * 70), (7, "-" * 199),
        (8, "=-" * 20 + " " * 205), (9, " " * 200), (10, "a" * 100 + "b" * 150), (11, "a" * 150 + "b" * 110), (12, "日本" * 120 + "é😀" * 60), (13, "本" + "日本" * 110 + "é😀" * 60),
    ]
    assert found(spark, texts) == plain_spans(texts)


def test_shared_spans_edge_cases(spark):
    rng = random.Random(5)
    long = noise(rng, 40_000)
    copy = noise(rng, 500)
    texts = [(1, None), (2, ""), (3, " "), (4, long), (5, "z" + long[100:20_100]), (6, copy), (7, copy), (8, copy), (9, copy[:199]), (10, copy[:200])]
    assert found(spark, texts) == plain_spans(texts)
    again = [(1, copy), (1, copy)]  # one document delivered twice shares nothing with itself
    assert found(spark, again) == set()
    assert len(found(spark, [(1, copy + long[:900]), (1, copy), (2, long[:1200]), (3, copy)])) >= 3  # two texts of one doc_id don't fail
    assert found(spark, []) == set() and found(spark, [(None, copy), (1, copy)]) == set()
    amounts = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_share) for r in spans.shared_amounts(with_clashes(docs(spark, texts))).collect()}
    assert amounts[1] == (0, 0, None) and amounts[6] == (500, 500, 1.0) and amounts[9] == (199, 0, 0.0) and len(amounts) == 10


def test_shared_spans_of_documents(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    assert {tuple(r) for r in spans.shared_spans(with_clashes(d)).collect()} == plain_spans([(r.doc_id, r.text) for r in d.collect()])


def test_boundaries_depend_on_their_context_only():
    """A stretch of SPAN characters keeps its boundaries, wherever it stands."""
    rng = random.Random(11)
    for letters in ("abcdefgh ", "ab", "a-"):
        for _ in range(30):
            inner = noise(rng, spans.SPAN, letters)
            kept = []
            for _ in range(2):
                left = noise(rng, rng.randrange(0, 400), letters)
                text = left + inner + noise(rng, rng.randrange(0, 400), letters)
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                at = spans.recompress(codes, np.zeros(len(codes), int)) - len(left)
                kept.append(set(at[(at >= spans.CONTEXT) & (at <= spans.SPAN - spans.CONTEXT)].tolist()))
                hashes = spans.Hashes(codes)
                at, _ = spans.kept_boundaries(codes, np.zeros(len(codes), int), np.array([0]), hashes)
                at = at - len(left)
                assert ((at >= spans.CONTEXT) & (at <= spans.SPAN - spans.CONTEXT)).any()
            assert kept[0] == kept[1]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    rel = duck.sql(queries.ORACLES[name])
    assert as_rows(df.columns, df.collect()) == as_rows(rel.columns, rel.fetchall())


def test_summaries_in_small_pieces(spark, data, monkeypatch):
    """Partitions that are summarised and merged piece by piece keep the stated error."""
    monkeypatch.setattr(quantiles, "BUILD_ROWS", 64)
    monkeypatch.setattr(quantiles, "MERGE_TUPLES", 500)
    df = spark.read.parquet(f"{data}/output_communities.parquet")
    check_percentiles(quantiles.community_percentiles(df).collect(), exact_groups(df), quantiles.EPS)


def test_the_error_of_combined_days_is_bounded():
    """What stored days and the merges of combining spend is the permitted error."""
    spent = lambda eps: eps / 2 + eps / 4 + eps / 4
    later = 2 * (1 - quantiles.DAYS) * quantiles.EPS
    assert spent(quantiles.DAYS * quantiles.EPS) + later / 4 + later / 4 <= quantiles.EPS * (1 + 1e-12)
