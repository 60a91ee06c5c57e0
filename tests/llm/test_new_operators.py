"""Conversation repair, WARC archives and the source audit against brute force and round trips."""

import gzip
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconloom.llm import conversation_repair as repair
from reconloom.llm import source_audit, tries, warc
from reconloom.llm.common import MOST_HASH, hash_limit
from reconloom.sources.durable import folder

SPACE = "\x20\x09-\x0d"


# --- samples


def test_sample_limits_are_fine_at_any_size():
    for total in (12_001, 5 * 10**6, 9 * 10**9, 5 * 10**10, 10**13):
        assert abs(hash_limit(total, 12_000) / (MOST_HASH + 1) * total - 12_000) < 1


# --- op11


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.sub(f"[{SPACE}]+$", "", text)
        out.append("blank" if not re.search(f"[^{SPACE}]", text) else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def _all_repairs(rows, most):
    """Cheapest edits by trying all of them, with at most ``most`` insertions in one place."""
    faults, best = _faults(rows), None
    places = [[[("I", r, "", 5) for r in ins] for k in range(most + 1) for ins in itertools.product(("user", "assistant"), repeat=k)] for _ in range(len(rows) + 1)]
    per_row = []
    for (role, text), fault in zip(rows, faults, strict=True):
        ways = [("D", None, None, 2)]
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            ways += ([("K", role, text, more)] if role else []) + [("R", r, text, 1 + more) for r in ("user", "assistant")]
        per_row.append(ways)
    for kept in itertools.product(*per_row):
        for ins in itertools.product(*places):
            seq = [e for k, way in enumerate(kept) for e in [*ins[k], way]] + ins[-1]
            initials = "".join(e[1][:1] for e in seq if e[0] != "D")
            if re.fullmatch("(s?(ua)+)?", initials):
                key = (sum(e[3] for e in seq), "".join(e[0] for e in seq))
                if best is None or key < best[0]:
                    best = (key, "\n".join(f"{e[1]}:{e[2]}" for e in seq if e[0] != "D"))
    return best[0][0], best[0][1], best[1]


def _conversations(seed, n, most):
    rng = random.Random(seed)
    texts = ["Hi.", "Hi.", "no end", " \n", "", "Yes!", "What?  ", "x"]
    return {c: [(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts)) for _ in range(rng.randrange(most + 1))] for c in range(n)}


def test_repairs_are_the_cheapest_and_ascii_least(spark):
    made = {c: rows[:3] for c, rows in _conversations(1, 60, 3).items()}
    df = spark.createDataFrame([(c, k, r, t) for c, rows in made.items() for k, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in repair.repair(df).collect()}
    assert set(got) == {c for c, rows in made.items() if rows}
    for c, r in got.items():
        cost, audit, text = _all_repairs(made[c], 2)
        faults = Counter(_faults(made[c]))
        pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(made[c])]
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()), made[c]
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["gaps"]) == (faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), 0)


def test_segments_give_what_whole_conversations_give(spark):
    rng = random.Random(4)
    rows = []
    for c, own in _conversations(2, 25, 40).items():
        for k, (r, t) in enumerate(own):
            rows += [(c if c else None, rng.choice([k, k, None, k // 3]), r, t or None)] * rng.choice([1, 1, 1, 4])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["conv"]: tuple(r) for r in repair.repair(df).collect()}
    cut = {r["conv"]: tuple(r) for r in repair.repair(df, long_turns=5, segment=2).collect()}
    assert whole == cut and len(whole) > 15
    turns = repair.repair(df, long_turns=5, segment=2, output="turns").orderBy("conv", "position").collect()
    flat = defaultdict(list)
    for t in turns:
        flat[t["conv"]].append(t)
    for c, own in flat.items():
        assert "".join(t["edit"] for t in own) == whole[c][7]
        text = "\n".join(f"{t['role']}:{t['text']}" for t in own if t["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == whole[c][8]


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, Code string, gone int"
    assert repair.repair(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, None, "x", 1), (2, 3, "user", "Hi." * 200_000, "x", 1), (2, 9, "assistant", "é" * 10 + ".", "x", 1), (3, 5, "user", "Hi.", "y", 0)]
    got = {r["conv"]: r for r in repair.repair(spark.createDataFrame(rows, schema), dropped=F.col("conv_id") == 3).collect()}
    assert (got[1]["blank"], got[1]["audit"], got[1]["gaps"]) == (1, "D", 0) and (got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (5, "KK", 0)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- op12


def test_archives_are_warc_with_a_member_a_record(spark, tmp_path):
    rng = random.Random(1)
    same = "é\r\n\r\nWARC/1.1\r\n\r\n" * 80
    pages = [(k, f"http://x/{k}", "".join(rng.choice("ab\r\n") for _ in range(rng.randrange(4000)))) for k in range(60)]
    pages += [(100, None, same), (101, "http://y\r\nEvil: 1", same), (102, "http://z", same), (103, "u", None), (104, "u", ""), (105, "u", "short"), (106, "u", "short"), (None, "n", same), (102, "again", same), (110, "u", "é\n" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("HTML_key", F.lit(1)).repartition(3)
    streams, out = folder(spark, "t-streams"), folder(spark, "t-archives")
    warc.write_streams(df, streams, rows_a_file=9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        warc.normalise(spark, streams, out)
        found = warc.index(spark, out).collect()
        read = warc.records(spark, out).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == len(read) == len(pages)
    files = {}
    for r in found:  # every record by its offset alone
        data = files.setdefault(r["file"], open(out.removeprefix("file://") + "/records/" + r["file"], "rb").read())
        one = zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31)
        assert one.startswith(b"WARC/1.1\r\n") and f"WARC-Record-ID: {r['record_id']}\r\n".encode() in one and one.endswith(b"\r\n\r\n")
    for name, data in files.items():  # and the file is gzip as a whole
        assert gzip.decompress(data).count(b"WARC-Record-ID: ") == sum(r["file"] == name for r in found)
    by_id = defaultdict(list)
    for r in found:
        by_id[r["record_id"]].append(r)
    for page, _, html in pages:
        body = (html or "").encode()
        for r in by_id[f"<urn:page:{'' if page is None else page}>"]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
    kinds = {p: [(r["record_type"], r["refers_to"]) for r in by_id[f"<urn:page:{p}>"]] for p in (100, 101, 102, 105, 106)}
    assert kinds == {100: [("revisit", "<urn:page:102>")], 101: [("revisit", "<urn:page:102>")], 102: [("response", None)] * 2, 105: [("response", None)], 106: [("response", None)]}
    assert [r["record_type"] for r in by_id["<urn:page:>"]] == ["response"]
    some = {r["record_id"]: r for r in warc.fetch(spark, out, ["<urn:page:110>", "<urn:page:7>", "<urn:page:100>", "<urn:none>"]).collect()}
    assert set(some) == {"<urn:page:110>", "<urn:page:7>", "<urn:page:100>"} and bytes(some["<urn:page:7>"]["payload"]).decode() == pages[7][2] and some["<urn:page:100>"]["payload"] is None


def test_foreign_streams_are_normalised_and_broken_ones_refused(spark, tmp_path):
    def put(name, *records, cut=0):
        (tmp_path / name).mkdir()
        data = gzip.compress(b"".join(records))
        (tmp_path / name / "a.warc.gz").write_bytes(data)
        (tmp_path / name / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[:1])[: len(records[0]) - cut]))
        return f"file://{tmp_path}/{name}"

    binary = bytes(range(256)) * 40 + b"\r\n\r\n\r\n" + bytes(range(255, -1, -1))
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    other = b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:b>\r\ncontent-length: %d\r\n\r\nX: 1\r\n\r\n%s\r\n\r\n" % (len(binary) + 8, binary)
    out = folder(spark, "t-foreign")
    warc.normalise(spark, put("good", info, other, info), out)
    got = warc.records(spark, out).collect()
    assert Counter(r["record_id"] for r in got) == {"<urn:a>": 3, "<urn:b>": 1}
    assert [bytes(r["payload"]) for r in got if r["record_type"] == "resource"] == [binary]
    for bad in (put("cut", other, cut=40), put("no", b"hello there\r\n\r\n"), put("long", other.replace(b"length: 1", b"length: ", 1))):
        with pytest.raises(Exception, match="record|Content-Length"):
            warc.normalise(spark, bad, folder(spark, "t-bad"))
    empty, out = folder(spark, "t-none"), folder(spark, "t-none-out")
    warc.write_streams(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    warc.normalise(spark, empty, out)
    assert warc.index(spark, out).count() == 0 and json.dumps(warc.index(spark, out).columns)


# --- op13


def test_tries_merge_and_cut():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randrange(1, 60))) for _ in range(400)} | {b"a" * 5000, b"a" * 4999 + b"b"})
    parts, docs, counts = [], Counter(), Counter()
    for _ in range(4):
        own = rng.sample(words, 150)
        d, by = {w: rng.randrange(1, 5) for w in own}, {s: {w: rng.randrange(1, 9) for w in rng.sample(own, 70)} for s in (-5, 3, 9)}
        docs.update(d)
        counts.update({(w, s): n for s, c in by.items() for w, n in c.items()})
        parts.append(tries.Trie.opened(tries.Trie.counted(d, by).packed()))
    whole = tries.Trie.merged(parts)
    assert whole.terms == sorted(docs) and whole.docs.tolist() == [docs[t] for t in whole.terms]

    def cells(t):
        ends = [0, *t.ends.tolist()]
        return {(w, s): n for i, w in enumerate(t.terms) for s, n in zip(t.sources[ends[i] : ends[i + 1]].tolist(), t.counts[ends[i] : ends[i + 1]].tolist(), strict=True)}

    assert cells(whole) == dict(counts)
    for depth in (1, 3, 7):
        pieces = list(whole.cut(depth))
        assert [p for p, _ in pieces] == sorted({w[:depth] for w in whole.terms}) and cells(tries.Trie.merged([t for _, t in pieces])) == dict(counts)
    kept = whole.keep(whole.docs >= 6)
    assert kept.terms == [t for t in whole.terms if docs[t] >= 6] and cells(kept) == {k: n for k, n in counts.items() if docs[k[0]] >= 6}
    assert tries.shared_lengths([b"a" * 4999, b"a" * 5000, b"a" * 4999 + b"b"]).tolist() == [0, 4999, 4999]


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(total)
        assert source_audit.shares(np.array([count]), np.int64(total))[0] == 1 + 1_000_000_000 * (count + 1) // total


def _audit(rows, least, top):
    words = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {x[0] for x in words}:
        df = Counter(w for n, _, ws in words if n == lang for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        counts = {s: Counter() for n, s, _ in words if n == lang}
        for n, s, ws in words:
            if n == lang:
                counts[s].update(w for w in ws if df[w] >= least)
        every = sum(counts.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        shares, q = {s: p(c) for s, c in counts.items()}, p(every)
        for s, own in shares.items():
            pairs = [(sum((own[w] - o[w]) ** 2 // o[w] for w in kept), x) for x, o in shares.items() if x != s]
            terms = [((own[w] - q[w]) ** 2 // q[w], w) for w in kept if counts[s][w] and own[w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked if part == "pair" else ranked[:top])}
    return out


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = ["Été", "ete", "ß", "naïve", "日本", "x", "Z", *("".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))) for _ in range(60)), "k" * 300]
    rows = [(rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s2", "é", None, "S1"]), " ".join(rng.choice(words) + rng.choice(["", "1", "-", "É"]) for _ in range(rng.randrange(60)))) for _ in range(90)]
    rows += [("xx", "only", "one"), ("xx", "two", None), ("yy", "s", ""), ("en", "s1", "same same same")] + [("en", "s1", "same copy")] * 5
    df = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "lang string, source string, text string, prefix int").repartition(5)
    want = _audit(rows, 3, 20)
    assert {tuple(r) for r in source_audit.audit(df, top=20).collect()} == want and len(want) > 60
    # small tries, prefixes cut deeper, bands of sources, small blocks, texts in pieces
    monkeypatch.setattr(source_audit, "CELLS", 6)
    monkeypatch.setattr(source_audit, "PIECE", 50)
    assert {tuple(r) for r in source_audit.audit(df, top=20, depth=1, flush=30, wide=12, block=5).collect()} == want
    assert source_audit.audit(df.limit(0)).count() == 0
