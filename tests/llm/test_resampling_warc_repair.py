"""Importance resampling, WARC archives and conversation repair against plain Python."""

import base64
import glob
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geolode.llm import conversation_repair, importance, warc

DOCS = "doc_id long, text string"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, width):
    words = WORDS.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(words), [b" ".join(words[k : k + n]) for n in range(1, width + 1) for k in range(len(words) - n + 1)]


def resampled(docs, target, width, buckets, least, percent):
    s, t = Counter(), Counter()
    for texts, totals in ((docs, s), (target, t)):
        for _, text in texts:
            totals.update(zlib.crc32(f) % buckets for f in features(text, width)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        n, found = features(text, width)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in found)
        rows.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return rows, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize("width", [1, 2, 3])
def test_resampling_equals_plain_python(spark, monkeypatch, width):
    monkeypatch.setattr(importance, "NODES", 50)  # tries are cleared again and again
    monkeypatch.setattr(importance, "PIECE", 40)  # texts come in pieces
    rng = random.Random(width)
    vocabulary = ["alpha", "BETA", "gamma9", "naïve", "漢字", "x", "the", "of"] + [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) + rng.choice(["", ".", "\n!"])) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (None, docs[3][1]), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (300, "alpha " * 4000)]
    target = [(k, " ".join(rng.choices(vocabulary[:20], k=30))) for k in range(12)] + [(99, None)]
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(-1) for c in ("weight", "score", "place", "rank", "__place", "key")})
    goal = spark.createDataFrame(target, DOCS)
    rows, drawn = resampled(docs, target, width, 101, 10, 20)
    scores = importance.scored(df, importance.learned(df, goal, width, 101), width, keep=["doc_id"])
    assert Counter(map(tuple, scores.collect())) == Counter(rows)
    ranks = importance.ranked(scores, least_words=10, percent=20).filter("rank is not null").orderBy("rank").collect()
    assert [(r["rank"], r.doc_id, r.score) for r in ranks] == [(k, r[0], r[4]) for k, r in enumerate(drawn, 1)]
    out = importance.resample(df, goal, width, 101, 10, 20).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in out) == Counter(drawn)
    assert all(r.place == -1 and r.key == -1 for r in out)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "a b c " * 10)], DOCS)
    assert importance.ranked(importance.scored(none, importance.learned(none, none), keep=["doc_id"])).collect() == []
    assert importance.resample(some, none).collect() == [] and importance.resample(none, some).collect() == []
    row = importance.ranked(importance.scored(some, importance.learned(some, none), keep=["doc_id"])).first()
    assert row.n_words == 30 and row["rank"] is None


PAGES = [
    (3, "http://a b/é?x=1", "hello"),
    (1, None, "hello"),
    (1, None, "hello"),
    (2, "http://x/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (5, "u", None),
    (4, "", ""),
    (None, "http://n/", "hello"),
    (None, "http://m/", "alone"),
    (7, "x\r\nInjected: 1", "naïve 漢" * 50000),
    (8, "http://[bad", "q\n"),
]


def page_rows(pages):
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    rows = []
    for key, _, html in pages:
        raw, to = (html or "").encode(), first.get(html or "")
        again = to is not None and key != to
        rows.append((key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None, 3))
    return Counter(rows)


def test_pages_come_back_from_archives(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(-1) for c in ("key", "digest", "payload", "n", "row", "archive", "type")})
    assert Counter(map(tuple, warc.round_trip(df).collect())) == page_rows(PAGES)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_are_files_that_others_can_read(spark, tmp_path, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "a"), compression=compression, archive_bytes=2000)
    files = glob.glob(str(tmp_path / "a/part*"))
    assert len(files) > 3
    payloads, names = [], []
    for name in files:
        raw = open(name, "rb").read()
        raw = gzip.decompress(raw) if compression == "gzip" else raw
        while raw:  # a plain reader: head, length, block, two line ends
            head, _, rest = raw.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            block, raw = rest[:n], rest[n + 4 :]
            assert len(block) == n and rest[n : n + 4] == b"\r\n\r\n"
            names.append(re.search(rb"WARC-Record-ID: (\S+)", head)[1])
            if b"WARC-Type: response" in head:
                payloads.append(block.partition(b"\r\n\r\n")[2])
                assert base64.b32encode(hashlib.sha1(payloads[-1]).digest()) == re.search(rb"sha1:(\w+)", head)[1]
    kept = [html.encode() if html else b"" for key, _, html in PAGES if key not in (3, 5) and (key is not None or html == "alone")]
    assert sorted(payloads) == sorted(kept)
    captures = warc.assemble(warc.read(spark, str(tmp_path / "a"))).collect()
    assert len(captures) == len(PAGES) and sorted(bytes(r.response.payload) for r in captures if r.response.type == "response") == sorted(kept)
    assert all(len(r.requests) == len(r.metadata) == 1 and r.response.status == 200 for r in captures)


def test_records_are_led_to_their_response(spark, tmp_path):
    rec = lambda kind, name, to=(), block=b"": warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), *[("WARC-Concurrent-To", f"<{t}>") for t in to]], block)
    parts = [rec("response", "a"), rec("request", "b", ["a"]), rec("metadata", "c", ["b"]), rec("metadata", "d", ["b", "a"]), rec("request", "e"), rec("response", "f", ["e"], b"x" * 9), rec("metadata", "g", ["e", "h"]), rec("metadata", "h", ["e", "g"]), rec("request", "i", ["nowhere"]), rec("metadata", "j", ["nowhere"]), rec("resource", "k"), rec("conversion", "l", ["a"])]
    (tmp_path / "1.warc").write_bytes(b"".join(parts[::2]))
    (tmp_path / "2.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[1::2]))  # a member for each record
    rows = warc.assemble(warc.read(spark, str(tmp_path))).collect()
    got = {r.capture_id: (r.response and r.response.record_id, [x.record_id for x in r.requests], sorted(x.record_id for x in r.metadata)) for r in rows}
    assert got == {"a": ("a", ["b"], ["c", "d"]), "f": ("f", ["e"], ["g", "h"]), "nowhere": (None, ["i"], ["j"]), "k": ("k", [], [])}
    (tmp_path / "3.warc").write_bytes(rec("response", "z", (), b"123456789")[:-8])
    with pytest.raises(Exception, match="3.warc is no whole WARC archive"):
        warc.read(spark, str(tmp_path)).count()


TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """By trying every edit of every row, and inserts anywhere: the least (cost, audit) and what it leaves."""
    best = None
    gaps = list(itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1))
    for edits in itertools.product("DKua", repeat=len(rows)):
        if any(e != "D" and f in (1, 2) for e, (_, _, f) in zip(edits, rows)):
            continue
        for gap in gaps:
            roles, audit, cost, said = [], "", 0, []
            for k in range(len(rows) + 1):
                for g in gap[k]:
                    name = {"u": "user", "a": "assistant"}[g]
                    roles.append(g)
                    said.append(f"{name}:")
                    audit, cost = audit + "I", cost + 5
                if k < len(rows):
                    role, text, fault = rows[k]
                    e = edits[k]
                    audit += e if e in "DK" else "R"
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and fault == 3 else 0)
                    if e != "D":
                        name = role if e == "K" else {"u": "user", "a": "assistant"}[e]
                        roles.append(name[:1])
                        said.append(f"{name}:{text}")
            if re.fullmatch("(s?(ua)+)?", "".join(r or "-" for r in roles)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, said)
    return best


def test_paths_equal_trying_everything():
    rng = random.Random(3)
    for trial in range(60):
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), f"t{k}.", rng.choice([0, 0, 0, 1, 2, 3])) for k in range(rng.randint(0, 3 if trial < 50 else 4))]
        machine = [(r[:1], f) for r, _, f in rows]
        cost, audit = conversation_repair.closed(conversation_repair.shortest(machine, "0"))
        turns = [{"turn": k, "role": r, "text": t} for k, (r, t, _) in enumerate(rows)]
        said = [f"{t['role']}:{t['text']}" for t in conversation_repair.applied(turns, audit, "0")]
        assert (cost, audit, said) == cheapest(rows)


def test_products_of_blocks_equal_the_whole():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(1, 40))]
        cuts = sorted({0, len(rows), *(rng.randint(1, len(rows)) for _ in range(4))})
        matrices = [{q: conversation_repair.shortest(rows[a:b], q) for q in "0SUA"} for a, b in zip(cuts, cuts[1:])]
        parts = conversation_repair.product(matrices)
        assert (sum(p[1] for p in parts), "".join(p[2] for p in parts)) == conversation_repair.closed(conversation_repair.shortest(rows, "0"))


def test_long_conversations_in_blocks_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    said = ["yes.", "no?", "what", "", " \n", "so it is!", "once more."]
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(said) if rng.random() < 0.3 else f"turn {k}.") for k in range(1200)]
    rows += [(1, 5, "user", "turn 5 again.")] * 3 + [(2, None, None, None), (2, None, "user", "hi."), (2, 9, "assistant", "ho."), (None, 1, "user", "a."), (None, 2, "assistant", "b.")]
    rows += [(3, 0, "user", "x" * 100_000 + "."), (3, 1, "assistant", "ok.")]
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(-1) for c in ("conv", "none", "block", "cut", "place", "known", "audit", "cost")})
    got = {r.conv_id: r for r in conversation_repair.summary(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted(((t is not None, t or 0), r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv)
        turns = [{"turn": t[1] if t[0] else None, "role": r, "text": x} for t, r, x in own]
        faults = conversation_repair.faults(turns, set())
        cost, audit = conversation_repair.closed(conversation_repair.shortest([(t["role"][:1], f) for t, f in zip(turns, faults)], "0"))
        numbers = {t["turn"] for t in turns} - {None}
        pairs = [a["role"][:1] + b["role"][:1] for a, b in zip(turns, turns[1:])]
        want = (max(numbers) - min(numbers) + 1 - len(numbers), faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit)
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want
        left = "\n".join(f"{t['role']}:{t['text']}" for t in conversation_repair.applied(turns, audit, "0"))
        assert r.repaired_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert len(got[1].audit) > 1000 and (got[None].cost, got[None].audit) == (0, "KK")
    repaired = conversation_repair.repair(df).filter("conv_id = 1").orderBy("block", "place").collect()
    assert "\n".join(f"{t.role}:{t.text}" for t in repaired) == "\n".join(f"{t['role']}:{t['text']}" for t in conversation_repair.applied([{"turn": t[1] if t[0] else None, "role": r, "text": x} for t, r, x in sorted(((t is not None, t or 0), r, x) for c, t, r, x in rows if c == 1)], got[1].audit, "0"))
    assert conversation_repair.summary(df.limit(0)).collect() == []


def test_damage_by_hash_and_conversations_that_lose_all(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    want = Counter()
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: (x or " ").translate(str.maketrans("", "", ".!?"))}.get(k, x or " ")
        want[c, t, "user" if k == 4 else r or " ", text] += (k != 0) + (k == 3)
    assert Counter(map(tuple, conversation_repair.damaged(spark.createDataFrame(rows, TURNS)).collect())) == +want
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = conversation_repair.damaged_and_repaired(spark.createDataFrame([(gone, 0, "user", "x")], TURNS)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
