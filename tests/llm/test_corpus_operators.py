"""Operators against the library, brute force, held-out labels and hard rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from reconloom.llm import chat_format, embedding_dedup, fingerprints, jaccard_join, language_id, mixing, packed, packing, quality, substring_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 89}" for k in range(30_000))
#: Nulls, empty and very long texts, ties, repeated rows, clashing further columns.
HARD = [
    (1, "one two three four five six", "en", "a"), (2, "", "en", "a"), (3, None, None, None), (4, LONG, "en", "b"), (5, LONG, "en", "b"), (5, LONG, "en", "b"), (6, " \t\n\x0b\x0c\r ", "de", None),
    (7, "123 456 !!!", "de", ""), (8, "ÄÖÜ straße   漢字 🙂 <|endoftext|> <|im_end|>", None, "b"), (9, "one two three four five six", "en", "a"), (None, "no id here", "en", "a"), (10, " nbsp ", "en", None), (11, "a " * 5000, "en", "a"),
]
EXTRA = "42 AS score, 'x' AS copies, 1 AS own, 2 AS length_, 'k' AS key, 7 AS n_tokens, 'z' AS size, 'q' AS label"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).selectExpr("*", *EXTRA.split(", ")).repartition(3)


@pytest.fixture(scope="module")
def none(spark, hard):
    return spark.createDataFrame([], hard.schema)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words(t):
    return WORD.findall(t or "")


def test_word_splitting_is_the_contract():
    for _, t, *_ in HARD:
        assert [w.decode() for w in packed.words(t)] == words(t)
        assert [w.decode() for w in packed.lowered_words(t)] == words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


# --- embeddings
def _vectors(spark, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(120, 16))
    rows = [*base, *(base[:40] + 0.05 * rng.normal(size=(40, 16))), *(base[0] + 0.02 * rng.normal(size=(60, 16))), base[3], base[3] * 2.0]
    out = [(i, [float(v) for v in x]) for i, x in enumerate(rows)]
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15), (906, [1.0, 2.0]), (None, [1.0] * 16)]
    return out, bad


@pytest.mark.parametrize("indexed", [False, True])
def test_embeddings_equal_brute_force(spark, monkeypatch, indexed):
    good, bad = _vectors(spark)
    if indexed:  # an index and several blocks for each crowded cell
        for name, value in (("FEW", 40), ("STORED", 16), ("GUESTS", 32)):
            monkeypatch.setattr(embedding_dedup, name, value)
    other = [(910, [2.0]), (911, [0.5]), (912, [-1.0]), (913, [3.0, 6.0])]  # of one component, and with 906
    df = spark.createDataFrame([*good, *bad, *other, good[5]], "vec_id long, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    x = np.array([v for _, v in good])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[near[i]].min() for i in range(len(x))])
    links = near.sum(axis=1) - 1
    found = np.array([got[i][0] for i in range(len(x))])
    assert links.sum() > 3000
    if indexed:
        assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
        assert sum(got[i][1] == label[i] for i in range(len(x))) >= 0.97 * len(x)
    else:
        assert (found == links).all() and all(got[i][1] == label[i] for i in range(len(x)))
    assert all(got[i] == (0, i, True) for i in [*range(900, 906), 912])
    assert [got[i] for i in (906, 913, 910, 911)] == [(1, 906, True), (1, 906, False), (1, 910, True), (1, 910, False)]
    assert got[None] == (0, None, False)


def test_ids_with_several_vectors_tie_their_components(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (1, 1), 4: (0, 4)}


@pytest.mark.parametrize("width", [64, 768])
def test_held_out_recall(width):
    rng = np.random.default_rng(width)
    x, held = (rng.normal(size=(n, width)) for n in (3000, 500))
    x, held = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, held))
    for total in (50_000, 100_000_000):
        index = embedding_dedup.fit(x, total, 0.95)
        near = embedding_dedup.moved(held, 0.95, rng)
        place = index.place_of(near, held)
        assert (place < index.visits).mean() >= 0.95
        cells, own = index.nearest_cells(held[:50]), index.nearest_cells(near[:50], 1)
        assert ((cells == own).any(axis=1) == (place[:50] < index.visits)).all()


def test_codes_bound_every_product():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(300, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1, keepdims=True) / 127
    code = np.round(u / scale) * scale
    left = np.linalg.norm(u - code, axis=1)
    error = left[:, None] + left[None, :]
    assert (np.abs(u @ u.T - code @ code.T) <= error + error * error).all()


def test_embeddings_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(empty).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    index = embedding_dedup.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)), 9)
    x = rng.normal(size=(20, 6))
    total = ((x[:, None, :3] - index.first) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - index.second) ** 2).sum(2)[:, None, :]
    assert (np.sort(total.reshape(20, -1), axis=1)[:, :9] == pytest.approx(np.take_along_axis(total.reshape(20, -1), index.nearest_cells(x), 1)))


# --- mixing
def _targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        open_ = [s for s in names if s not in full]
        t = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if t[s] > most * sizes[s]]
        if not over:
            return {**full, **t}
        full |= {s: most * sizes[s] for s in over}


def test_mixing_hits_targets(spark, hard, docs):
    for df in (hard, docs):
        rows = df.collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(words(r["text"]))
        want = _targets(sizes)
        got = mixing.decide(df).collect()
        assert sum(r["rows"] for r in got) == len(rows)
        taken = Counter()
        for r in got:
            assert r["copies"] <= 3 and r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]], abs=1e-5)
            taken[r["source"]] += r["rows"] * r["copies"] * r["size"]
        for s, t in want.items():
            largest = max(len(words(r["text"])) for r in rows if r["source"] == s)
            assert t - largest - 1e-3 <= taken[s] <= t + 1e-3
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.decide(df.repartition(5)).collect()))
        out = mixing.mix(df)
        assert out.columns == df.columns
        assert out.count() == sum(r["rows"] * r["copies"] for r in got)


def test_mixing_nothing(none):
    assert mixing.decide(none).count() == 0 and mixing.mix(none).count() == 0


# --- language
def test_language_held_out(spark, docs, hard, none):
    model = language_id.fit(docs.where("doc_id % 3 > 0"))
    got = language_id.predict(docs.where("doc_id % 3 = 0"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    odd = {r["doc_id"]: r for r in language_id.predict(hard, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (2, 3, 6, 7))
    assert all(0 < odd[i]["score"] <= 1 for i in (1, 4, 8, 10))
    assert language_id.predict(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(hard, language_id.fit(none)).collect()} == {"und"}


# --- packing
def test_word_tokens_equal_library():
    tokens = packing.WordTokens(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    letters = [*string.printable, *"ÉéﬁŁßİΣς漢🙂  ́\x85\x1c", "<|endoftext|>", "'s", "'LL", " ", " "]
    for t in [t for _, t, *_ in HARD if t] + ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(1500)]:
        assert tokens.ids(packing.words(t)) == np.array(tokens.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_packing_is_gapless(spark, hard, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for df in (hard, docs):
        got = packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
        ids = Counter()
        for r in df.collect():
            full = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            for k, lo in enumerate(range(0, len(full), 4096)):
                part = full[lo : lo + 4096]
                ids[r["doc_id"], k, lo, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
        assert ids == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
        by = {}
        for r in got:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 4096
        total = sum(r["length"] for r in got)
        assert len(by) <= -(-total // 4096) + 1
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_rank_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.zeros(513, dtype=np.int64)
    np.add.at(hist, np.clip((rng.gamma(1.2, 90, 3000)).astype(int), 1, 512), 1)
    if seed == 1:
        hist[:] = 0
        hist[300] = 50
    tries = packing.TRIES if seed % 2 else ((7, 1 / 8),)
    plan = packing.plan(hist, 512, tries)
    assert plan.grouped or seed == 3
    fill, seen = Counter(), Counter()
    used: dict[int, list] = {}
    for length, rank, count, first, per, offset in zip(plan.length, plan.rank, plan.count, plan.bin, plan.per, plan.offset, strict=True):
        for k in range(count):
            seen[length, rank + k] += 1
            b = first + k // per
            fill[b] += length
            used.setdefault(b, []).append((offset + k % per * length, length))
    assert set(seen.values()) == {1} and Counter(n for n, _ in seen) == Counter({n: int(c) for n, c in enumerate(hist) if c})
    assert max(fill.values()) <= 512
    for parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    assert len(fill) == plan.bins
    if seed % 2 and seed > 1:
        assert plan.bins <= -(-(hist * np.arange(513)).sum() // 512) + 1


def test_configurations_reach_the_linear_bound():
    # three of 100 and one of 200 fill 500; so do 300 and 200: 60 + 60 sequences hold all
    sizes, counts = np.array([300, 200, 100]), np.array([60, 120, 180])
    found = packing.configurations(sizes, counts, 500)
    assert sum(n for _, n in found) == 120 and (sum(t * n for t, n in found) == counts).all()
    assert all((t * sizes).sum() <= 500 for t, _ in found)


def test_packing_takes_no_more_sequences_than_best_fit(docs):
    rng = np.random.default_rng(9)
    for scale in (1, 50):
        hist = np.zeros(4097, dtype=np.int64)
        np.add.at(hist, np.clip(rng.lognormal(5.6, 1.5, 4000).astype(int), 1, 4096), 1)
        hist *= scale
        made = packing.plan(hist, 4096)
        assert made.bins <= packing.plan(hist, 4096, ((0, 1.0),)).bins
        assert made.bins <= 1.001 * (hist * np.arange(4097)).sum() / 4096 + 1


# --- fingerprints
def test_prefix_hashes():
    rng = random.Random(4)
    a = "".join(rng.choices("abc", k=3000))
    b = a[:1700] + "z" + a[1701:]
    x, y = (fingerprints.prefixes(np.frombuffer(t.encode("utf-32-le"), dtype="<u4")) for t in (a, b))
    for _ in range(300):
        i, j, n = rng.randrange(2900), rng.randrange(2900), rng.randrange(100)
        assert (fingerprints.span(x, i, i + n) == fingerprints.span(y, j, j + n)) == (a[i : i + n] == b[j : j + n])
    assert fingerprints.common_extension(x, 0, y, 0) == 1700
    assert fingerprints.common_extension(x, 1701, y, 1701) == 1299


def _fp(text):
    return fingerprints.encode(fingerprints.prefixes(np.frombuffer(text.encode("utf-32-le"), dtype="<u4")))


def test_likeness_of_edited_texts():
    rng = random.Random(14)
    for n in (300, 5000, 60_000):
        t = "".join(rng.choices(string.ascii_lowercase + " ", k=n))
        for other in ("x" + t + "y", t[: n // 3] + "new" + t[n // 3 :], t[10:] + t[:10], t[:5] + "Q" + t[6:-5] + "Q" + t[-4:], t[: n // 2] + "".join(rng.choices(string.ascii_uppercase, k=n // 2)), "".join(rng.choices(string.ascii_lowercase, k=n))):
            a, b = ({x[k : k + 24] for k in range(len(x) - 23)} for x in (t, other))
            share = len(a & b) / max(len(a), len(b))
            assert abs(fingerprints.likeness(_fp(t), _fp(other)) - share) < 0.25 and fingerprints.likeness(_fp(t), _fp(t)) == 1
    assert fingerprints.likeness(_fp(""), _fp("")) == 1 and fingerprints.likeness(_fp(""), _fp("a")) == 0 and fingerprints.likeness(_fp("ab"), _fp("abc")) > 0.5


def test_range_of_large_ids_beside_nulls_is_exact(spark):
    rows = [(2**62 + k, f"text {k} " * 3) for k in range(40)] + [(None, "none")]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows_each=7).collect()}
    texts = [t for _, t in rows[-1:] + rows[:-1]]
    for (i, t), after in zip(rows[-1:] + rows[:-1], texts[1:] + texts[:1], strict=True):
        k = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()


def test_fingerprints_equal_brute_force(spark, hard, docs, none):
    for df in (hard, docs):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))
        got = fingerprints.compare_with_edited(df, rows_each=17).collect()
        want = Counter()
        for (ok, i, t), (_, _, after) in zip(rows, rows[1:] + rows[:1], strict=True):
            k = len(t) // 2
            want[i if ok else None, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()] += 1
        assert want == Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
        by_text = {}
        texts = {i: t for ok, i, t in rows if ok}
        for r in got:
            assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
            assert r["n_chars"] - r["n_chars"] // 2 <= r["same_start"] and r["same_start"] + r["same_end"] <= r["n_chars"]
            if r["doc_id"] is not None:
                by_text.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
        assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert np.mean([r["near_edited"] for r in got]) > 0.4 > 0.1 > np.mean([r["near_next"] for r in got])
    assert fingerprints.compare_with_edited(none).count() == 0


# --- token counts
def test_token_counts_equal_library(spark, hard, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    odd = spark.createDataFrame([(k, "".join(rng.choices([*string.printable, *"é漢🙂 \x85 ", "  ", "\n ", " \n", "<|endoftext|>", "'ll"], k=rng.randint(0, 60)))) for k in range(800)], "doc_id long, text string")
    for df in (hard, docs, odd):
        got = token_counts.token_counts(df, P.path("byte_bpe_50k.json")).collect()
        assert len(got) == df.count()
        for r in got:
            t = r["text"] or ""
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0


# --- Jaccard join
def test_jaccard_equals_brute_force(spark, hard, none):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in HARD]
    base = [[f"t{rng.randrange(5000)}" for _ in range(n)] for n in (6, 20, 60, 200)]
    for k in range(160):
        own = list(base[k % 4])
        for _ in range(rng.randrange(0, max(1, len(own) // 12) + 1)):
            own[rng.randrange(len(own))] = f"T{rng.randrange(99999)}"
        rows.append((100 + k, " ".join(own)))
    common = " ".join(f"boiler{k}" for k in range(30))
    rows += [(500 + k, common + " " + " ".join(f"u{k}_{j}" for j in range(8 + k % 5))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("clash")).repartition(6)
    sets = []
    for i, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                parent[max(x, y)] = min(x, y)
    got = jaccard_join.similar_classes(df).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))
    assert jaccard_join.similar_classes(none).count() == 0
    kept = {r["doc_id"] for r in jaccard_join.keep_one(hard).collect()}
    assert kept == {1, 2, 3, 4, 6, 7, 8, None, 10, 11}


# --- quality
def test_quality_held_out(spark, data, docs, hard, none):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs.where("doc_id % 4 <> 2"), labels.where("doc_id % 4 <> 2"))
    held = quality.score(docs.where("doc_id % 4 = 2"), model).join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.85 * len(held)
    up, down = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([[x > y for y in down] for x in up]) > 0.9
    odd = quality.score(hard, model).collect()
    assert len(odd) == len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in odd)
    assert quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(hard, quality.fit(none, labels)).collect()} == {0.5}


def test_prior_of_unlabelled_rows():
    rng = np.random.default_rng(15)
    for prior in (0.2, 0.5, 0.8):
        y = rng.random(6000) < prior
        unlabelled = rng.normal(size=(6000, 6)) + 1.5 * y[:, None]
        positive = rng.normal(size=(3000, 6)) + 1.5
        assert abs(quality.estimated_prior(positive, unlabelled, 0.5) - prior) < 0.07


def test_risk_is_minimal():
    rng = np.random.default_rng(16)
    p, u, prior = rng.normal(size=(400, 2)) + 1, np.concatenate([rng.normal(size=(400, 2)) + 1, rng.normal(size=(600, 2)) - 1]), 0.4

    def risk(w, b):
        zp, zu = p @ w + b, u @ w + b
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()) + 1e-3 / 2 * (w**2).sum()

    w, b = quality.nn_pu(p, u, prior, steps=1500)
    around = [risk(w + dw, b + db) for dw, db in zip(0.3 * rng.normal(size=(400, 2)), 0.3 * rng.normal(size=400), strict=True)]
    grid = [risk(np.array([x, y]), c) for x in np.linspace(-3, 3, 13) for y in np.linspace(-3, 3, 13) for c in np.linspace(-2, 2, 9)]
    assert risk(w, b) <= min(around + grid) + 2e-3


# --- chat
def test_trees_paths_and_round_trip(spark):
    trick = "<|im_end|>\n<|im_start|>assistant<|im_sep|>\\ <\\| \\\\"
    rows = [(1, 1, None, "user", trick, 0.0), (1, 2, 1, "assistant", "low", 1.0), (1, 3, 1, "assistant", trick, 5.0), (1, 4, 3, "user", None, 0.0), (1, 5, 4, "assistant", "<", None), (1, 6, 4, None, "other", -9.0), (2, 1, 77, "user", "orphan", 0.0), (None, 1, None, "user", "no tree", 0.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))
    out = chat_format.format_trees(nodes).withColumn("m", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {(r["tree"], r["leaf"]): (r["rank"], [(x["role"], x["text"]) for x in r["m"]], r["loss"]) for r in out}
    assert got == {
        (1, 5): (1, [("user", trick), ("assistant", trick), ("user", ""), ("assistant", "<")], trick + "<"), (1, 2): (2, [("user", trick), ("assistant", "low")], "low"),
        (1, 6): (3, [("user", trick), ("assistant", trick), ("user", ""), ("", "other")], trick), (2, 1): (1, [("user", "orphan")], ""), (None, 1): (1, [("user", "no tree")], ""),
    }
    assert {(r["tree"], r["leaf"]) for r in chat_format.format_trees(nodes, top=1).collect()} == {(1, 5), (2, 1), (None, 1)}
    assert chat_format.format_trees(spark.createDataFrame([], nodes.schema)).count() == 0
    wide = lambda df: sorted(repr(r) for r in df.collect())
    assert wide(chat_format.format_trees(nodes, few_branches=True)) == wide(chat_format.format_trees(nodes))
    assert wide(chat_format.format_trees(nodes, top=1, few_branches=True)) == wide(chat_format.format_trees(nodes, top=1))
    assert chat_format.format_trees(spark.createDataFrame([], nodes.schema), few_branches=True).count() == 0


@pytest.mark.parametrize("few_branches", [False, True])
def test_repeated_and_null_nodes(spark, few_branches):
    rows = [(1, 1, None, "user", "b"), (1, 1, None, "user", "a"), (1, 2, 1, "assistant", "end"), (1, 2, 1, "assistant", "end"), (2, None, None, "user", "loose"), (2, 1, None, "user", "bound")]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string")
    out = chat_format.format_trees(nodes, few_branches=few_branches).withColumn("m", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    got = {(r["tree"], r["leaf"]): ([x["text"] for x in r["m"]], r["loss"]) for r in out}
    assert len(out) == 3 and got == {(1, 2): (["a", "b", "end", "end"], "endend"), (2, None): (["loose"], ""), (2, 1): (["bound"], "")}


def test_long_chain(spark):
    rows = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    out = chat_format.format_trees(chat_format.threads(rows)).withColumn("m", chat_format.read_back(F.col("formatted"))).collect()
    assert len(out) == 1 and [x["text"] for x in out[0]["m"]] == [str(k) for k in range(700)]


def test_cycle_above_a_leaf_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1)], "tree long, node long, parent long")
    with pytest.raises(ValueError):
        chat_format.leaf_paths(nodes, 3).count()


# --- substrings
def _brute(rows):
    seen, out = {}, Counter()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in order:
        w = words(t)
        for p in range(len(w) - 19):
            seen.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if i is not None and seen[tuple(w[p : p + 20])] < (i, p):
                gone[p : p + 20] = [True] * 20
        out[i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    return out


def test_substrings_equal_brute_force(spark, none):
    rng = random.Random(8)
    passage = [f"p{rng.randrange(50)}" for _ in range(90)]
    rows = [(r[0], r[1]) for r in HARD]
    for k in range(80):
        own = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            a, n = rng.randrange(70), rng.randrange(15, 60)
            at = rng.randrange(len(own) + 1)
            own[at:at] = passage[a : a + n]
        if k % 9 == 0:
            own[3:3] = ["same"] * rng.randrange(20, 70)
        if k % 7 == 0:
            own += ["ab", "cd"] * 25
        rows.append((100 + k, "\n".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("n_chars", F.length("text").cast("long")).repartition(5)
    got = substring_dedup.removal(df).collect()
    assert Counter(tuple(r) for r in got) == _brute(rows)
    cut = substring_dedup.deduplicated(df)
    assert cut.columns == df.columns
    by = {(i, h): n - g for i, n, g, h in _brute(rows)}
    for r in cut.collect():
        own = words(r["text"])
        assert by[r["doc_id"], hashlib.sha256(" ".join(own).encode()).hexdigest()] == len(own)
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) or (r["text"] is None and r["n_chars"] == 0)
    assert substring_dedup.removal(none).count() == 0 and substring_dedup.deduplicated(none).count() == 0


def test_spans_have_equal_names_if_and_only_if_they_are_equal(monkeypatch):
    rng = np.random.default_rng(11)
    for _ in range(120):
        docs = [packed.mixed(rng.integers(0, rng.integers(1, 5), size=rng.integers(1, 90)).astype(np.uint64)) for _ in range(3)]
        by_words, by_name = {}, {}
        for ids in docs:
            for width in (12, 20):
                start = np.arange(max(0, len(ids) - width + 1))
                for i, n in zip(start.tolist(), substring_dedup.Grammar(ids, substring_dedup.LEVELS).names(start, width).tolist(), strict=True):
                    by_words.setdefault(ids[i : i + width].tobytes(), set()).add(n)
                    by_name.setdefault(n, set()).add(ids[i : i + width].tobytes())
        assert all(len(v) == 1 for v in by_words.values()) and all(len(v) == 1 for v in by_name.values())


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = np.random.default_rng(12)
    docs = [packed.mixed(rng.integers(0, 7, size=n).astype(np.uint64)) for n in (20, 150, 700, 31)]
    alone = [substring_dedup.Slice([d], 20).revealing()[0] for d in docs]
    monkeypatch.setattr(substring_dedup, "CHUNK", 33)
    for (p, n), (q, m) in zip(substring_dedup.Slice(docs, 20).revealing(), alone, strict=True):
        assert (p == q).all() and (n == m).all()
    known = [p for p, _ in alone]
    for d, (start, name, _) in zip(docs, substring_dedup.Slice(docs, 20).named(known), strict=True):
        assert (start == np.arange(len(d) - 19)).all() and len(set(name.tolist())) == len({d[i : i + 20].tobytes() for i in start})


def test_texts_without_repeats_lose_nothing(spark):
    rows = [(k, " ".join(f"u{k}x{j}" for j in range(60))) for k in range(6)]
    got = substring_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in got) == _brute(rows)


def test_borders_depend_on_context_only():
    rng = np.random.default_rng(3)
    for _ in range(60):
        core = rng.integers(0, 4, size=40).astype(np.uint64)
        left, right = (rng.integers(0, 4, size=rng.integers(0, 30)).astype(np.uint64) for _ in range(2))
        alone, inside = substring_dedup.borders(packed.mixed(core)), substring_dedup.borders(packed.mixed(np.concatenate([left, core, right])))
        c = substring_dedup.CONTEXT
        assert (alone[c : 40 - c + 1] == inside[len(left) + c : len(left) + 40 - c + 1]).all()


# --- pipeline
def test_pipeline_stages(spark, data, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "mixing", "packing"]
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = kept
        kept = stage(spark, before, data).cache()
        assert kept.columns == docs.columns
        if k == 1:
            labels = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_classes(before).collect()}
            assert {r["doc_id"] for r in kept.collect()} == set(labels.values())
        if k == 2:
            want = Counter((i, h) for i, _, _, h in _brute([(r["doc_id"], r["text"]) for r in before.collect()]))
            assert Counter((r["doc_id"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in kept.collect()) == want
    packed_rows = corpus_pipeline.STAGES[4][1](spark, kept, data)
    assert packed_rows.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()


def test_pipeline_takes_hard_rows(spark, data, hard, none, docs):
    import corpus_pipeline

    more = docs.where("doc_id < 60").select(F.col("doc_id") + 5000, *docs.columns[1:], *[F.expr(e) for e in EXTRA.split(", ")]).toDF(*hard.columns)
    before = hard.unionByName(more).cache()
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data).cache()
        ids = Counter(r["doc_id"] for r in after.collect())
        if name == "language_id":
            assert not set(ids) & {2, 3, 6, 7} and len(ids) > 50
            before, after = after, hard.unionByName(more)  # the rows that went are for the other stages
            ids = Counter(r["doc_id"] for r in after.collect())
        elif name == "jaccard_join":
            assert [ids[k] for k in (1, 9, 4, 5, None, 2, 3)] == [1, 0, 1, 0, 1, 1, 1]
        elif name == "substring_dedup":
            assert ids == Counter(r["doc_id"] for r in before.collect())
        elif name == "packing":
            assert sum(r["length"] for r in after.collect()) > 0 and set(ids) == {r["doc_id"] for r in before.collect()}
        assert name == "packing" or after.columns == columns
        before = after
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, data).count() == 0


def test_mixing_by_a_quality_column(spark):
    rows = [(k, " ".join(["word"] * 10), "a", float(k % 2)) for k in range(400)] + [(1000 + k, " ".join(["word"] * 100), "b", None) for k in range(10)]
    got = mixing.decide(spark.createDataFrame(rows, "doc_id long, text string, source string, good double"), weights=(1, 2), quality="good").where("source = 'a'").collect()
    most = max(r["copies"] for r in got)
    sooner = [r["doc_id"] % 2 for r in got if r["copies"] == most]
    assert 0 < len(sooner) < 400 and np.mean(sooner) > 0.9


def test_language_counts_are_those_of_naive_bayes(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr")] * 5)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(spark.createDataFrame([(1, "hund und katze"), (2, "the cat and dog"), (3, "chien et chat")], "doc_id long, text string"), model).collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["de", "en", "fr"] and all(s > 0.5 for _, s in got.values())


def test_language_learns_from_all_rows(spark):
    """25,000 labelled rows, one of them in a language of its own; a sample of 20,000 has other shares and medians."""
    text = F.concat_ws(" ", *[F.element_at(F.array(*map(F.lit, ws)), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(4)) + 1).cast("int")) for k, ws in enumerate([("der", "hund", "the", "dog"), ("und", "katze", "and", "cat"), ("ein", "haus", "a", "house")])])
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 17, "le chien").otherwise(text).alias("text"), F.when(F.col("id") == 17, "fr").when(F.col("id") % 5 < 2, "de").otherwise("en").alias("lang"))
    model = language_id.fit(docs)
    assert model.languages == ["de", "en", "fr"] and np.exp(model.log_prior) * 25_000 == pytest.approx([10_000, 14_999, 1], rel=1e-12)
    found = language_id.usual(docs, model)
    best = model.log_prob.max(axis=0)
    rows = [r["text"] for r in docs.select("text").collect()]
    h, owner, _ = language_id._grams(rows, model.bits)
    grams, mean = language_id._best_mean(best, h, owner, len(rows))
    square = np.bincount(owner, weights=(best * best)[h], minlength=len(rows)) / grams
    spread = np.median(np.sqrt(np.maximum(square - mean**2, 0)))
    assert found.centre == pytest.approx(np.median(mean), rel=1e-12) and found.gram_spread == pytest.approx(spread, rel=1e-9)
    assert found.text_spread == pytest.approx(max(1.4826 * np.median(abs(mean - np.median(mean))), language_id.LEAST_SPREAD * spread), rel=1e-9)


def test_median_is_exact(spark, monkeypatch):
    monkeypatch.setattr(language_id, "_TAKEN", 3)
    rng = random.Random(7)
    for n in (0, 1, 2, 5, 40, 41):
        for values in ([rng.gauss(-2, 1) for _ in range(n)], [float(rng.randrange(3)) for _ in range(n)], [-1e300, 1e300][: n % 3] + [1.0 + k * 2**-52 for k in range(n // 2)]):
            got = language_id.median(spark.createDataFrame([(x,) for x in values], "v double"), "v")
            assert got == (float(np.median(values)) if values else None)


def test_language_stage_rejects_foreign_texts_and_noise(spark, data, docs):
    import corpus_pipeline

    rng = random.Random(5)
    some = lambda letters, a, b, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(a, b))) for _ in range(n))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem."
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью."
    bad = [polish, russian, "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心。", some(string.ascii_lowercase, 2, 9, 40), some(string.ascii_letters + string.digits + "+/", 76, 76, 8)] * 2
    clean = {r["lang"]: r["text"] for r in docs.where("n_chars between 400 and 4000").orderBy(F.desc("doc_id")).collect()}
    assert len(clean) == 4
    good = [x[:200] + " " + y[:200] for x in clean.values() for y in clean.values()] + [x[: x.index(" ", n)] for x in clean.values() for n in (10, 30, 60)]
    more = [(1_000_000 + k, t, None if k % 2 else "en", "a", len(t)) for k, t in enumerate(bad + good)]
    mixed = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, mixed, data).select("doc_id").collect()}
    assert not kept & {1_000_000 + k for k in range(len(bad))}
    assert kept >= {1_000_000 + k for k in range(len(bad), len(more))}
    assert kept >= {r["doc_id"] for r in docs.where("text rlike '[a-z]'").collect()}


def test_near_copies_leave_one_of_repeated_rows(spark):
    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, text, "a")] * 3 + [(1, text, "b"), (1, other, "a"), (2, text, "a"), (2, text, "a"), (3, None, None), (3, None, None), (4, "", "a"), (4, "", "a"), (None, text, "a"), (None, text, "a"), (5, "alone", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = Counter(tuple(r) for r in jaccard_join.keep_one(df).collect())
    assert got == Counter([(1, text, "a"), (1, other, "a"), (3, None, None), (4, "", "a"), (None, text, "a"), (None, text, "a"), (5, "alone", "a")])
