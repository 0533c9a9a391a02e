"""The training-data operators against brute force, round trips and held-out labels, and on odd inputs."""

import base64
import gzip
import hashlib
import io
import itertools
import random
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import decontam, fsm, jaccard, licenses, linerules, packing, quality, secrets, tokens, toxicity, vocab, warc
from weftline.llm.features import indicators, scores
from weftline.llm.grams import Words, as_string, blocks, hash_text

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = "doc_id bigint, text string, size int, label string, id string, shard int, n int, g string, a string"
HOT = "alpha beta gamma delta"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], schema)


def odd(spark):
    """Nulls, empties, a long text, repeats, a null id and clashing columns."""
    rows = [(1, None), (2, ""), (3, "word. " * 30000), (4, "same text here. And more of it."), (4, "same text here. And more of it."), (None, "no id here."), (5, "!!! ??"), (6, "x")]
    return spark.createDataFrame([(i, t, 1, "l", "i", 2, 3, "g", "a") for i, t in rows], CLASH)


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


# --- grams


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .é日\n", max_size=30), max_size=8), st.integers(1, 4))
def test_grams_follow_the_rule(texts, n):
    seen = {}
    for base, arr in blocks(pa.array(texts, pa.string()), 16):
        w = Words(arr)
        g, ptr = w.grams(n)
        for r in range(len(arr)):
            ws = words(texts[base + r])
            assert w.ptr[r + 1] - w.ptr[r] == len(ws)
            want = [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [tuple(ws)] * bool(ws)
            got = g[ptr[r] : ptr[r + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(want, got):
                assert seen.setdefault((n, a), b) == b
    assert len(set(seen.values())) == len(seen)


# --- 9 Jaccard join


def brute_pairs(rows, n, t):
    sets = {i: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} for i, x in rows if (w := words(x))}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        if j >= t:
            out[a, b] = j
    return out


def copies(seed, n=60):
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        base = [rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(pool)
            rows.append((len(rows), HOT + " " + " ".join(w) if rng.random() < 0.5 else " ".join(w)))
    return rows


def brute_links(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    """{doc_id: (class, links)} by all pairs."""
    pairs = brute_pairs(rows, n, t)
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}
    for a, b in pairs:
        links[a], links[b] = links[a] + 1, links[b] + 1
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (root[i], links[i]) for i, _ in rows}


def links(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"]) for r in df.collect()}


@pytest.mark.parametrize("hot,block,pivots", [(64, 2048, 64), (2, 2048, 0), (2, 8, 5), (64, 2048, 3)])
def test_join_is_exact(spark, hot, block, pivots):
    rows = copies(hot + pivots, 80)
    assert links(jaccard.jaccard_join(docs(spark, rows), hot=hot, block=block, pivots=pivots)) == brute_links(rows)


def near_group(seed, size, groups, edits, shared):
    """Groups of near copies of long texts, each with a passage that all texts of all groups share."""
    rng = random.Random(seed)
    pool = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(pool) for _ in range(shared)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(pool) for _ in range(260)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(pool)
            at = rng.randrange(len(w))
            w[at:at] = passage
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("shared", [0, 150, 330])
@pytest.mark.parametrize("hot,block,pivots", [(64, 2048, 64), (4, 16, 0)])
def test_join_is_exact_whatever_is_common(spark, monkeypatch, shared, hot, block, pivots):
    monkeypatch.setattr(jaccard, "COMMON", 0.005)
    rows = near_group(shared, 12, 8, 40, shared)
    assert links(jaccard.jaccard_join(docs(spark, rows), hot=hot, block=block, pivots=pivots)) == brute_links(rows)


def shuffled(spark):
    """Bytes that each stage so far wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in range(2, 6)))
    return {x.stageId(): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def test_join_sends_little_of_texts_without_partners(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 16)
    monkeypatch.setattr(jaccard, "SLICE", 4_000)
    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for k in range(1000)]
    rows += [(2000 + k, x + " and more") for k, x in rows[:20]]
    before = shuffled(spark)
    got = links(jaccard.jaccard_join(docs(spark, rows)))
    assert {i: x for i, x in got.items() if x != (i, 0)} == {i: (k, 1) for k in range(20) for i in (k, 2000 + k)}
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 6 * sum(len(x.split()) - 2 for _, x in rows)


def test_deduplication(spark):
    rows = copies(5)
    want = brute_links(rows)
    assert {r["doc_id"] for r in jaccard.deduplicate(docs(spark, rows)).collect()} == {i for i, _ in rows if want[i][0] == i}


def test_components(spark):
    rng = random.Random(3)
    edges = [(a, b) for _ in range(80) if (a := rng.randrange(100)) != (b := rng.randrange(100))] + [(k, k + 1) for k in range(200, 260)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {(r["id"], r["label"]) for r in jaccard.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)).collect()} == set(root.items())


def test_join_odd(spark):
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(odd(spark)).collect())
    assert got == [(i, i, 0) for i in (1, 2, 3, 4, 5, 6)]
    kept = jaccard.deduplicate(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 8
    assert jaccard.jaccard_join(docs(spark, [])).count() == 0


# --- 3 decontamination


def brute_score(doc, item):
    h = [[0] * (len(doc) + 1) for _ in range(len(item) + 1)]
    for i, j in itertools.product(range(1, len(item) + 1), range(1, len(doc) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (2 if doc[j - 1] == item[i - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h)) / (2 * len(item))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=25))
def test_alignment(item, doc):
    s, a, b, matched = decontam.align(np.array(doc, np.uint64), np.array(item, np.uint64))
    assert s == pytest.approx(brute_score(doc, item)) and a <= b and matched <= len(item)
    assert brute_score(doc[a:b], item) == pytest.approx(s) and 2 * matched >= s * 2 * len(item) and matched <= sum(x in item for x in doc[a:b])


def test_decontamination(spark):
    rng = random.Random(2)
    pool = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(30))) for k in range(6)]
    rows, want = [], set()
    for k in range(40):
        w = [rng.choice(pool) for _ in range(80)]
        if k % 3 == 0:
            item = items[k % 6][1].split()
            for _ in range(k % 4):
                item[rng.randrange(30)] = "edit"
            if k % 2:
                del item[10]
            at = rng.randrange(80)
            w[at:at] = item
            want.add((k, k % 6))
        rows.append((k, " ".join(w)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    brute = {(i, j) for i, t in rows for j, x in items if brute_score(words(t), words(x)) >= decontam.MIN_SCORE}
    for limit in (decontam.SLICE_GRAMS, 30):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(spark, rows), bench, slice_grams=limit).collect()}
        assert want <= got == brute
    assert {r["doc_id"] for r in decontam.decontaminate(docs(spark, rows), bench).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_all_copies_above_the_bound_of_seeds_are_found(spark):
    rng = random.Random(8)
    pool = [f"v{k}" for k in range(500)]
    items = {k: [rng.choice(pool) for _ in range(rng.choice([12, 25, 60]))] for k in range(8)}
    rows = []
    for k in range(150):
        w = list(items[k % 8])
        for _ in range(rng.randint(0, len(w) // 2)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], ["edit"], [rng.choice(pool)]])
        rows.append((k, " ".join([rng.choice(pool) for _ in range(rng.randint(0, 40))] + w + [rng.choice(pool) for _ in range(rng.randint(0, 40))])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contaminated(docs(spark, rows), bench).collect()}
    brute = {(i, j): s for i, t in rows for j, x in items.items() if (s := brute_score(words(t), x)) >= decontam.MIN_SCORE}
    assert all(got[p] == pytest.approx(brute[p]) for p in got) and {p for p, s in brute.items() if s >= 0.5 + 1 / (len(items[p[1]]) + 2)} <= set(got) <= set(brute) and len(got) > 100


def test_long_items_take_little_memory():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 1 << 40, 6000).astype(np.uint64)
    doc = np.concatenate([rng.integers(0, 1 << 40, 3000).astype(np.uint64), item, rng.integers(0, 1 << 40, 3000).astype(np.uint64)])
    tracemalloc.start()
    s, a, b, matched = decontam.align(doc, item)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (s, a, b, matched) == (1.0, 3000, 9000, 6000) and peak < 4 << 20


def test_decontamination_does_not_depend_on_how_often_a_copy_leaked(spark):
    rng = random.Random(5)
    item = [f"q{k}" for k in range(30)]
    edited = [f"edit{k}" if k % 7 == 6 else x for k, x in enumerate(item)]
    for verbatim, n in ((0, 4), (0, 100), (1, 100)):
        rows = [(k, " ".join([f"r{rng.randrange(10**6)}" for _ in range(20)] + edited + ["z"] * 5)) for k in range(n)]
        rows += [(1000 + k, " ".join(item)) for k in range(verbatim)] + [(2000, " ".join(item[:6]) + " and no more")]
        got = {r["doc_id"]: r["score"] for r in decontam.contaminated(docs(spark, rows), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()}
        assert got == {i: pytest.approx(brute_score(words(t), item)) for i, t in rows if i != 2000}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=12), st.lists(st.integers(0, 9), min_size=1, max_size=25))
def test_what_is_out_of_reach_never_aligns(item, doc):
    d, i = np.array(doc, np.uint64), np.array(item, np.uint64)
    assert decontam.within_reach(d, i, decontam.MIN_SCORE) or brute_score(doc, item) < decontam.MIN_SCORE


def test_decontamination_odd(spark):
    bench = spark.createDataFrame([(1, "same text here and more of it"), (2, None), (None, ""), (3, "word")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd(spark), bench).collect())
    assert (4, 1) in got and got.count((4, 1)) == 2 and all(i in (3, 4) for i, _ in got)
    assert decontam.contaminated(odd(spark), bench.limit(0)).count() == 0 and decontam.contaminated(odd(spark).limit(0), bench).count() == 0
    assert decontam.decontaminate(odd(spark), bench).where("doc_id IS NULL").count() == 1


# --- 6 token counts, 4 packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab'strelvdm 12!?.\n\té日😀XY ")), max_size=40), max_size=6), st.sampled_from([3, 16, 512]))
def test_transducer_counts_what_the_encoder_does(texts, chunk):
    blob = vocab.read()
    out, off = fsm.deltas(as_string(pa.array(texts, pa.string())), fsm.transducer(blob), chunk)
    total = np.append(0, np.cumsum(out, dtype=np.int64))
    encode = vocab.encoding(blob).encode_ordinary
    assert (total[off[1:]] - total[off[:-1]]).tolist() == [len(encode(t)) for t in texts]


def test_long_runs_without_a_border():
    blob, rng = vocab.read(), random.Random(3)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(30_000))
    texts = ["a" * 200_000, cjk, "ab" * 20_000 + " and more", "".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "x" + "\n" * 5000 + "=" * 40_000 + "y"]
    machine, encode = fsm.transducer(blob), vocab.encoding(blob).encode_ordinary
    for t in texts:
        fsm.deltas(as_string(pa.array([t])), machine)  # compiles the states
        began = time.time()
        got = int(fsm.deltas(as_string(pa.array([t])), machine)[0].sum(dtype=np.int64))
        assert time.time() - began < 3
        assert got == (len(encode(t)) if len(t) < 100_000 else 10 * len(encode("a" * 20_000)))


def test_token_counts(spark):
    got = tokens.token_counts(odd(spark)).collect()
    encode = vocab.encoding(vocab.read()).encode_ordinary
    want = [None if r["text"] is None else len(encode(r["text"])) for r in odd(spark).collect()]
    assert sorted(map(str, want)) == sorted(str(r["n_tokens"]) for r in got)
    assert tokens.token_counts(docs(spark, [])).count() == 0


def test_transducer_survives_a_reset(monkeypatch):
    monkeypatch.setattr(fsm, "MAX_STATES", 10)
    blob = vocab.read()
    texts = ["some words of text", "and others, too"] * 3
    encode = vocab.encoding(blob).encode_ordinary
    for t in texts:
        assert int(fsm.deltas(as_string(pa.array([t])), fsm.transducer(blob))[0].sum()) == len(encode(t))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.sampled_from([0.0, 2.0, 7.0])), min_size=1, max_size=10))
def test_packing_is_optimal(pieces):
    counts, penalty = [c for c, _ in pieces], [p for _, p in pieces]
    best = float("inf")
    for mask in range(1 << (len(pieces) - 1)):
        ends = [i + 1 for i in range(len(pieces) - 1) if mask >> i & 1] + [len(pieces)]
        lo, cost = 0, 0.0
        for e in ends:
            s = sum(counts[lo:e])
            cost += 10 - s + penalty[e - 1] if s <= 10 else float("inf")
            lo = e
        best = min(best, cost)
    cost, ends = packing.cuts(counts, penalty, 10)
    assert cost == pytest.approx(best) and ends[-1] == len(pieces)


def test_packing_covers_every_text_in_order(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(["word.", "other", "third!\n", "é"]) for _ in range(rng.randint(0, 400)))) for k in range(40)] + [(40, "long" * 900)]
    encode = vocab.encoding(vocab.read()).encode_ordinary
    wins = sorted(packing.pack(docs(spark, rows), window=64, shard=16).collect(), key=lambda r: (r["shard"], r["window"]))
    text, seen = dict(rows), {}
    for w in wins:
        assert 0 < w["n_tokens"] <= 64 and w["n_tokens"] + w["padding"] == 64
        for d, a, b in zip(w["doc_ids"], w["starts"], w["ends"]):
            assert seen.get(d, 0) == a
            seen[d] = b
    assert seen == {k: len(t) for k, t in rows if t}
    assert sum(w["n_tokens"] for w in wins) == sum(len(encode(t)) for t in text.values())
    flat = [d for w in wins for d in w["doc_ids"]]
    assert flat == sorted(flat)


def true_count(text, w, encode):
    return sum(len(encode(text[d][a:b])) for d, a, b in zip(w["doc_ids"], w["starts"], w["ends"]))


def test_windows_hold_the_tokens_they_report(spark):
    rng = random.Random(6)
    dense = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789") for _ in range(9000))
    plain = " ".join(rng.choice(["other", "words", "of", "the", "text"]) for _ in range(6000))
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))
    text = dict(enumerate([f"{dense} {plain}", f"{plain} {dense}", cjk, f"{cjk} {plain}", "!?-'" * 3000 + "s are odd", "x" + " " * 9000 + "y\n\n\nz", "😀é" * 3000, plain, "short."]))
    encode = vocab.encoding(vocab.read()).encode_ordinary
    for window in (2048, 64):
        wins = packing.pack(docs(spark, list(text.items())), window=window).collect()
        assert all(w["n_tokens"] == true_count(text, w, encode) <= window for w in wins)
        assert any(w["cut"] == "inside" for w in wins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["'s", "'", "ll", " ", "  ", "\n", "é", "😀", "日本", "word", "12", "!?", "\u3000", "zq"]), min_size=1, max_size=60), st.sampled_from([6, 9]))
def test_pieces_of_long_sentences(parts, window):
    blob = vocab.read()
    text = "".join(parts)
    arr = as_string(pa.array([text]))
    machine, data = fsm.transducer(blob), np.frombuffer(text.encode(), np.uint8)
    out, off = fsm.deltas(arr, machine)
    got = packing._pieces(data, out, fsm.borders(data, off), window, machine)
    encode = vocab.encoding(blob).encode_ordinary
    starts = [a for a, _ in got] + [len(data)]
    assert starts[0] == 0 and starts == sorted(set(starts))
    assert [n for _, n in got] == [len(encode(data[a:b].tobytes().decode())) for a, b in zip(starts, starts[1:])] and all(n <= window for _, n in got)


def test_packing_does_not_depend_on_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["word.", "other", "third!", "日本。語", "是。」だ"]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    spans = []
    for ids in (range(300), range(0, 300 * 1024, 1024), [None] * 300, [7] * 300):
        wins = packing.pack(docs(spark, list(zip(ids, texts))), window=64, shard=50).collect()
        assert len({w["shard"] for w in wins}) == 6
        spans.append((len(wins), [(w["shard"], w["n_tokens"], w["starts"]) for w in sorted(wins, key=lambda w: (w["shard"], w["window"]))]))
    assert spans[0] == spans[1] and abs(spans[2][0] - spans[0][0]) <= 6 and spans[2] == spans[3]


def test_packing_against_one_plain_run(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(10**9), " ".join(rng.choice(["word.", "other", "third!"]) for _ in range(rng.randint(1, 60)))) for _ in range(90)]
    encode = vocab.encoding(vocab.read()).encode_ordinary
    plain = []
    for lo in range(0, 90, 32):
        held = []
        for d, t in sorted(rows)[lo : lo + 32]:
            cut = [0, *(m.end() - 1 for m in re.finditer(r"[.!] ", t)), len(t)]
            held.append((d, [len(encode(t[a:b])) for a, b in zip(cut, cut[1:]) if a < b], [b for a, b in zip(cut, cut[1:]) if a < b], []))
        plain += packing.pack_shard(held, 64, packing.TRUNCATION, packing.HARD_TRUNCATION)
    got = sorted(packing.pack(docs(spark, rows), window=64, shard=32).collect(), key=lambda w: (w["shard"], w["window"]))
    assert [tuple(w)[2:] for w in got] == plain


def test_sentence_ends():
    blob = vocab.read()
    text = "One. Two? 三。四！」五 six\nseven। eight"
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    at = packing._sentences(data, off, fsm.borders(data, off))
    parts = [data[a:b].tobytes().decode() for a, b in zip(at, [*at[1:], len(data)])]
    assert parts == ["One.", " Two?", " 三。", "四！」", "五 six", "\nseven।", " eight"]


def test_packing_odd(spark):
    got = packing.pack(odd(spark)).collect()
    ids = [d for w in got for d in w["doc_ids"]]
    assert set(ids) == {3, 4, 5, 6, None} and packing.pack(docs(spark, [])).count() == 0


# --- 2 secrets


def test_secrets(spark):
    hexa = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    cases = {
        1: f'é token = "{hexa}" x', 2: f"commit {hexa} fixed", 3: "id 123e4567-e89b-12d3-a456-426614174000", 4: "call +1-800-555-1234-555-1234-99", 5: "internationalization_of_configuration_values",
        6: "key aB3xK9qLmZ7pR2tVwY5nC8dF1gH4jS6u here", 7: "api_key=Zx81QmPl0vTr55KdWq29LsYb", 8: "Donaudampfschifffahrtsgesellschaft and more",
    }
    got = {r["doc_id"]: r for r in secrets.secrets(docs(spark, list(cases.items()))).collect()}
    assert set(got) == {1, 6, 7}
    for i, r in got.items():
        assert cases[i][r["start"] : r["start"] + len(r["secret"])] == r["secret"]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, list(cases.items()))).collect()}
    assert masked[1] == 'é token = "[SECRET]" x' and masked[7] == "api_key=[SECRET]" and masked[2] == cases[2]


def test_low_ratios_are_found_whatever_their_shape(spark):
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    cases = {
        1: "key = qjxkzvwpbgtyhmdlrnfcqsvxkzwq", 2: "see QJXKZVWPBGTYHMDLRNFCQSVXKZ there", 3: "password: Tr0ub4dor&3xQ!9z.", 4: "token: k3x9QzR7mW2pLt5v", 5: f"token={uuid}", 6: "password: correcthorsebatterystaple",
        7: "secret => 123456789012345", 8: "JBSWY3DPEHPK3PXPJBSWY3DPEHPK", 9: "the einbereinachaukeitundkeit word", 10: "a Password is 日本 and no more", 11: "é pwd='é9x!Qz7#Lm2$Kp'",
    }
    got = {r["doc_id"]: r for r in secrets.secrets(docs(spark, list(cases.items()))).collect()}
    assert set(got) == {1, 2, 3, 4, 8, 11}
    assert got[3]["secret"] == "Tr0ub4dor&3xQ!9z" and got[11]["secret"] == "é9x!Qz7#Lm2$Kp" and all(cases[i][r["start"] : r["end"]] == r["secret"] for i, r in got.items())


RUNS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-")


def plain_secrets(text, encode):
    """The rules of the docstring, read character by character."""
    low, found, taken = "".join(c.lower() if c.isascii() else c for c in text), set(), set()
    names = ["token", "secret", "password", "passwd", "passphrase", "pwd", "credential", "bearer", "auth", "authorization"] + [a + s + "key" for a in ("api", "access", "private") for s in ("", " ", "_", "-")]
    blank, quote = " \t\n\r\f\v", "\"'`"

    def skip(i, chars, most=10**9):
        while i < len(text) and most and text[i] in chars:
            i, most = i + 1, most - 1
        return i

    def judge(lo, hi, least, known):
        bare = text[lo:hi].rstrip("=")
        if len(bare) < least or len(bare) / len(encode(bare)) >= 2.4:
            return
        core = bare.strip("=-_+/")
        shape = [4 if c == "-" else 1 if c in "0123456789abcdefABCDEF" else 9 for c in core]
        if not any(c.isalpha() for c in core) or (len(core) == 36 and [i for i, x in enumerate(shape) if x == 4] == [8, 13, 18, 23] and max(shape) < 9):
            return
        if not known:
            kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in core]
            changes = sum(1 for i in range(1, len(core)) if kinds[i] and kinds[i - 1] and kinds[i] != kinds[i - 1] and not ((kinds[i - 1], kinds[i]) == ("u", "l") and (i < 2 or not core[i - 2].isalnum())))
            if set(shape) == {1} and len(core) in (32, 40, 56, 64, 96, 128) or changes < 2 and len(bare) / len(encode(bare)) >= 1.9:
                return
        found.add((lo, hi))
        taken.update(range(lo, hi))

    i = 0
    while i < len(text):
        ends = []
        for name in sorted(names, key=lambda x: (not x.startswith("pass"), x == "auth")):
            if low.startswith(name, i):
                j = skip(skip(i + len(name), quote, 1), blank)
                sign = 2 if text.startswith("=>", j) else 1 if text[j : j + 1] in (":", "=") else 2 if low.startswith("is", j) and text[j + 2 : j + 3] in tuple(blank) else 0
                for size in ([2, 1] if sign == 2 and text.startswith("=>", j) else [sign] * bool(sign)):
                    k = skip(skip(j + size, blank), quote, 1)
                    end = k
                    while end < len(text) and text[end] not in blank + quote + "<>":
                        end += 1
                    if end > k:
                        ends.append((k, end))
        if ends:
            lo, hi = ends[0]
            judge(lo, lo + len(text[lo:hi].rstrip(".,;:)]}")), 12, True)
            i = hi
        else:
            i += 1
    values, runs, i = set(taken), [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in RUNS:
            j += 1
        if j - i >= 20 and not values & set(range(i, j)):
            before = low[max(0, i - 40) : i].rstrip(quote).rstrip(blank)
            for sign in ("=>", ":", "=", "is"):
                if before.endswith(sign):
                    before = before[: -len(sign)].rstrip(blank)
                    break
            judge(i, j, 20, any(before.rstrip(quote).endswith(x) for x in names))
        i = max(j, i + 1)
    return found


def test_secrets_against_a_plain_scan(spark):
    rng = random.Random(4)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
    sets = [chars, chars[:26], "0123456789abcdef", "0123456789", chars + "!&#é"]
    lead = ["", "", "token: ", "password = '", "Secret is ", "API key: "]
    word = lambda: rng.choice(lead) + "".join(rng.choice(rng.choice(sets)) for _ in range(rng.choice([5, 13, 21, 32, 40]))) if rng.random() < 0.5 else "".join(rng.choice(sets[rng.randrange(4)]) for _ in range(24))
    rows = [(k, " ".join(word() if rng.random() < 0.4 else rng.choice(["wörd", "text,", "42"]) for _ in range(20))) for k in range(150)]
    encode = vocab.encoding(vocab.read()).encode_ordinary
    want = sorted((i, s, e) for i, t in rows for s, e in plain_secrets(t, encode))
    assert len(want) > 100 and sorted((r["doc_id"], r["start"], r["end"]) for r in secrets.secrets(docs(spark, rows)).collect()) == want


def test_secrets_odd(spark):
    assert secrets.secrets(odd(spark)).count() == 0
    assert secrets.secrets(docs(spark, [])).count() == 0 and secrets.redact(docs(spark, [])).count() == 0
    back = secrets.redact(odd(spark))
    assert back.columns == odd(spark).columns and sorted(map(str, back.collect())) == sorted(map(str, odd(spark).collect()))


# --- 1 WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, None), (None, "http://b/", ""), (3, "http://c/", "x" * 300_000), (3, "http://c/", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["url"], r["html"]) for r in got), key=key) == sorted(rows, key=key) and all(r["status"] == "ok" and r["digest_ok"] for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0
    files = warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), roll=1)
    assert len(files) == 5 and warc.read_warc(spark, files).count() == 5


def test_warc_faults():
    good = [warc.record(f"body {k}".encode() * 2000, f"http://{k}/") for k in range(3)]
    statuses = lambda data: [r[2] for r in warc.read_stream(io.BytesIO(data))]
    assert statuses(b"".join(good)) == ["ok"] * 3 and statuses(b"") == []
    broken = bytearray(good[1])
    broken[len(broken) // 2 :] = b"\xff" * (len(broken) - len(broken) // 2)
    assert statuses(good[0] + bytes(broken) + good[2]) == ["ok", "corrupt", "ok"]
    assert statuses(good[0] + good[1][:-20]) == ["ok", "truncated"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = zlib.decompress(good[0], 31)
    lie = z.compress(plain.replace(b"body 0", b"bodx 0", 1)) + z.flush()
    assert statuses(lie) == ["digest"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert statuses(z.compress(plain[:-4]) + z.flush()) == ["length"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert statuses(z.compress(b"nothing\r\n\r\n") + z.flush() + good[0]) == ["header", "ok"]
    offsets = [r[1] for r in warc.read_stream(io.BytesIO(b"".join(good)))]
    assert offsets == [0, len(good[0]), len(good[0]) + len(good[1])]


def test_warc_urls_come_back_unchanged(spark):
    urls = ["http://a/\nb", " http://a/ ", "http://a/\r\nX: y", "", "\\n", "http://é/日", "\t", "http://a/%0A"]
    got = warc.round_trip(spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)], "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["url"] for r in got} == dict(enumerate(urls)) and all(r["status"] == "ok" for r in got)


def test_warc_of_another_writer():
    def member(head, block, wrong=0):
        out = io.BytesIO()
        with gzip.GzipFile("some name.warc", "wb", fileobj=out, mtime=5) as z:
            z.write("\r\n".join(["WARC/1.0", *head, f"content-LENGTH:   {len(block) + wrong}", "", ""]).encode() + block + b"\r\n\r\n")
        return out.getvalue()

    info = b"software: x\r\n"
    http = b"HTTP/1.0 404 Not Found\r\nA: b\r\n\r\nbody"
    data = (
        member(["WARC-Type: warcinfo", "Content-Type: application/warc-fields"], info)
        + member(["warc-type: response", "Content-Type: application/http;msgtype=response", "WARC-Target-URI: http://x/", "X-Long: one\r\n  two", f"WARC-Block-Digest: sha256:{hashlib.sha256(http).hexdigest()}", "WARC-Payload-Digest: sha-1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()], http)
        + member(["WARC-Type: resource", f"WARC-Block-Digest: md5:{hashlib.md5(b'other').hexdigest()}"], b"plain")
        + member(["WARC-Type: resource", "WARC-Block-Digest: blake9:abc"], b"plain")
        + member(["WARC-Type: resource"], b"plain", wrong=3)
    )
    got = list(warc.read_stream(io.BytesIO(data)))
    assert [(r[2], r[3], r[9]) for r in got] == [("ok", "warcinfo", None), ("ok", "response", True), ("digest", "resource", False), ("ok", "resource", None), ("length", "resource", None)]
    assert got[1][5] == "http://x/" and got[1][11] == b"body" and got[1][10]["x-long"] == "one two" and got[0][11] == info


def test_warc_bombs_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 1000)
    big = warc.record(b"0" * 3_000_000, "http://a/", level=9)
    small = warc.record(b"x", "http://b/")
    got = list(warc.read_stream(io.BytesIO(big + small)))
    assert [(r[1], r[2], len(r[11])) for r in got] == [(0, "ok", 3_000_000), (len(big), "ok", 1)]


# --- 7 rules


def test_rules(spark):
    text = "A fine sentence here.\nHome | About | Contact | Shop\nBUY!! NOW!! THE!! BEST!!\nword word word word word.\nPlease accept all cookies to go on.\nno end mark\n\nAnother fine one, it is."
    r = linerules.report(docs(spark, [(1, text), (2, "a | b | c | d"), (3, None), (4, ""), (5, "\n \n")])).collect()
    by = {x["doc_id"]: x for x in r}
    assert [by[1][f"n_{k}"] for k in linerules.RULES] == [1, 1, 1, 1, 1] and by[1]["text"] == "A fine sentence here.\nAnother fine one, it is."
    assert [by[i]["keep"] for i in (1, 2, 3, 4, 5)] == [by[1]["kept_chars"] >= 0.5 * by[1]["all_chars"], False, False, False, False]
    kept = linerules.clean_lines(odd(spark), min_kept=0.5)
    assert kept.columns == odd(spark).columns and {x["doc_id"] for x in kept.collect()} == {4, None}
    assert linerules.report(docs(spark, [])).count() == 0 and linerules.clean_lines(docs(spark, [])).count() == 0
    same = linerules.clean_lines(docs(spark, [(1, "Fine text.\nx | y | z")]), 0.1).collect()[0]
    assert same["text"] == "Fine text." and same["n_chars"] == 10


def test_lines_are_judged_once(spark):
    for df in (linerules.clean_lines(odd(spark)), linerules.report(odd(spark))):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2  # lines, and their words


# --- 5 quality, 8 toxicity


def labelled(spark, seed, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w = [rng.choice(["the", "river", "runs", "past", "old", "stone", "mills", "and", "slow", "boats"]) for _ in range(rng.randint(5, 60))]
        good, toxic = k % 4 != 0, k % 5 == 0
        if not good:
            w = [x.upper() + "!!" for x in w] if k % 8 else [x for x in w for _ in range(2)]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorp" + rng.choice(["ab", "ol", "en", "ix", "um", "ar", "os", "it", "ul", "ed", "ay", "in", "ow"])]))
        rows.append((k, " ".join(w)))
        labels.append((k, int(good), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_quality_held_out(spark):
    d, lab, rows = labelled(spark, 1)
    got = {r["doc_id"]: r["keep"] for r in quality.quality_scores(d, lab.where("doc_id < 120")).collect()}
    right = [got[i] == bool(q) for i, q, _ in rows if i >= 120]
    assert np.mean(right) > 0.95
    assert all(r["keep"] for r in quality.quality_scores(d, lab.limit(0)).collect())
    assert quality.quality_scores(odd(spark), lab).count() == 8 and quality.quality_scores(docs(spark, []), lab).count() == 0
    again = docs(spark, [(k, f"the text number {j}") for k in (0, 1) for j in range(300)])  # repeated ids are bounded too
    assert len(quality.sampled(again, lab, "quality", 20)) <= 40 and not quality.sampled(docs(spark, [(0, "x " * 30_000)]), lab, "quality", 20)


def test_scores_add_up():
    arr = as_string(pa.array(["a b !! a", "", None], pa.string()))
    index, ptr = indicators(arr, 18)
    assert np.diff(ptr).tolist() == [3 + 3 + 1 - 1, 3, 3] or np.diff(ptr)[1] == 3
    w = np.arange((1 << 18) + 15, dtype=float)
    s = scores(index, ptr, w, 1.0, 1 << 18)
    row = index[ptr[0] : ptr[1]]
    low = row[row < 1 << 18]
    assert s[0] == pytest.approx(w[low].sum() / np.sqrt(len(low)) + w[row[row >= 1 << 18]].sum() + 1.0)


def test_label_model_finds_the_better_voter():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3

    def noisy(p):  # a voter that is right with probability p
        return np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    votes = np.stack([noisy(0.95), noisy(0.9), noisy(0.65), noisy(0.8)], 1).astype(np.int8)
    votes = np.concatenate([votes, votes[:, 2:3]], 1)  # the weak voter twice
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = toxicity.LabelModel(patterns, counts)
    assert (2, 4) in m.cliques and m.accuracy[0] > m.accuracy[2]
    assert ((m.posterior[back.ravel()] > 0.5) == y).mean() > 0.93


def test_toxicity(spark):
    d, lab, rows = labelled(spark, 2)
    got = {r["doc_id"] for r in toxicity.toxic_documents(d, lab.where("doc_id < 160")).collect()}
    assert got == {i for i, _, t in rows if t}
    assert toxicity.toxic_documents(odd(spark), lab).count() == 0 and toxicity.toxic_documents(docs(spark, []), lab.limit(0)).count() == 0


def test_votes_code_and_decode():
    v = np.array(list(itertools.product([-1, 0, 1], repeat=3)), np.int8)
    assert (toxicity.decode(toxicity.encode(v), 3) == v).all()


# --- 10 licences


def test_licenses(spark):
    mit = "Copyright 2020. " + ". ".join(t.rstrip(".:") for t in licenses._LONG["MIT"][:1]) + ".\n" + ".\n".join(licenses._LONG["MIT"][1:]) + "."
    texts = [(1, "x\nReleased under the MIT License."), (2, "Licensed under the Apache License, Version 2.0."), (3, mit), (4, "We licensed nothing."), (5, None), (6, "This work is licensed under the GNU General Public License, version 3. And CC.\nLicensed under CC BY-NC 4.0.")]
    got = {(r["doc_id"], r["license"], r["rule"]) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {(1, "MIT", "notice"), (2, "Apache-2.0", "notice"), (3, "MIT", "full"), (6, "GPL-3.0", "notice"), (6, "CC-BY-NC-4.0", "notice")}
    assert licenses.scan(odd(spark)).count() == 0


def test_wrapped_licenses(spark):
    wrap = lambda t, width, mark="": "\n".join(mark + x for x in textwrap.wrap(t, width, break_long_words=False))
    body = {n: [t.rstrip(":") + (":" if t.endswith(":") else ".") for t in texts] for n, texts in licenses._LONG.items()}
    texts, want = [(0, "We ask for permission\nto use the MIT\nLicense text. Not licensed under\nthe MIT License.")], set()
    for name, sents in body.items():
        for width, mark in ((72, ""), (78, " * "), (70, "# "), (30, "// ")):
            texts.append((len(texts), "Some Title\n\n" + f"\n{mark.rstrip()}\n".join(wrap(t, width, mark) for t in sents) + "\n\nThe rest of it."))
            want.add((len(texts) - 1, name, "full"))
    texts.append((len(texts), "// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0\n//\n// Unless required by"))
    want.add((len(texts) - 1, "Apache-2.0", "partial"))
    texts.append((len(texts), "This work is licensed under the GNU General\nPublic License, version 3."))
    want.add((len(texts) - 1, "GPL-3.0", "notice"))
    got = {(r["doc_id"], r["license"], r["rule"]) for r in licenses.scan(docs(spark, texts)).collect()}
    assert want <= got and all(i for i, *_ in got)


def test_every_known_sentence_has_an_anchor():
    assert all(any(a in w for a in licenses.ANCHORS for w in s.split()) for s in licenses.KNOWN)


def test_rule_order_matters():
    assert licenses.matched(["mit_0", "other", "mit_1"]) == [("MIT", "partial", 2)] and licenses.matched(["mit_1", "mit_0"]) == []
    assert not any(w in licenses.TRAIL for s, c in licenses.KNOWN.items() if c.endswith("_notice") for w in s.split())


def bsd(n):
    return "\n".join(t.rstrip(":") + "." for t in licenses._LONG[f"BSD-{n}-Clause"])


def test_of_contained_rules_the_longer(spark):
    texts = [(1, bsd(2)), (2, bsd(3)), (3, bsd(3) + "\n" + bsd(2)), (4, bsd(3) + "\n" + bsd(3)), (5, "\n".join(bsd(3).split("\n")[k] for k in (0, 1, 3)))]
    got = {(r["doc_id"], r["license"], r["rule"]) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {(1, "BSD-2-Clause", "full"), (2, "BSD-3-Clause", "full"), (3, "BSD-3-Clause", "full"), (3, "BSD-2-Clause", "full"), (4, "BSD-3-Clause", "full"), (5, "BSD-3-Clause", "partial")}


LOOSE = {
    1: ("Licensed under MIT.", {"MIT"}), 2: ("# SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0"}), 3: ("Distributed under the MIT License, see LICENSE.", {"MIT"}),
    4: ("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", {"MIT", "Apache-2.0", "BSD-3-Clause"}), 5: ("Released under the GNU General Public License version 2 or later.", {"GPL-2.0"}),
    6: ("Licensed under mitigation.", set()), 7: ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), 8: ("We see licensed under MIT.", set()), 9: ("SPDX-License-Identifier: ", set()),
}


def test_looser_notices_like_the_sql(spark):
    import duckdb

    texts = [(i, t) for i, (t, _) in LOOSE.items()] + [(20 + k, t) for k, t in enumerate([bsd(2), bsd(3), bsd(3) + "\n" + bsd(2) + "\n" + bsd(3)])] + [(40, None), (41, "")]
    found = licenses.scan(docs(spark, texts)).toPandas()
    for i, (_, want) in LOOSE.items():
        assert set(found[found["doc_id"] == i]["license"]) == want, i
    documents = docs(spark, texts).toPandas()  # noqa: F841
    want = duckdb.sql(licenses.ORACLE).fetchall()
    assert sorted(map(tuple, found[["doc_id", "license", "rule", "n_sentences", "first_sentence"]].values.tolist())) == sorted(want)


def test_very_many_notices(spark):
    mit = licenses._LONG["MIT"][0].rstrip(":") + ".\n"
    text = mit + "Released under the MIT License.\nLicensed under CC BY 4.0.\n" * 50_000 + bsd(3)
    got = {(r["license"], r["rule"]) for r in licenses.scan(docs(spark, [(1, text)])).collect()}
    assert got == {("MIT", "notice"), ("CC-BY-4.0", "notice"), ("BSD-3-Clause", "full")}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_hash_text_matches_blocks():
    assert hash_text("a b c", 2).tolist() == Words(as_string(pa.array(["a b c"]))).grams(2)[0].tolist()
