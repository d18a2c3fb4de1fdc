"""Each training-data operator against plain Python on small fixtures: methods, odd values, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_contracts import linked_classes  # noqa: E402

from geolode.llm import chat_format, jaccard_join, license_scan, line_dedup, packing, quality_classifier, quality_rules, registry, secret_scan  # noqa: E402
from geolode.llm.licence_texts import TEMPLATES  # noqa: E402

CHAT = "conv_id long, turn long, role string, text string"


def chat_digest(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_of_many_turns_without_numbers_and_repeated(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "CROWDED", 300)
    rng, rows = random.Random(1), []
    rows += [(1, k, ("user", "assistant")[k % 2], f"turn {k} of a long talk") for k in range(5000)]
    rows += [(2, None, rng.choice(["user", "assistant"]), f"no number {k}") for k in range(700)]
    rows += [(3, 7, "assistant", "the same")] * 400 + [(3, 8, "user", None)]
    rows += [(4, 0, "user", ""), (4, 0, "user", ""), (None, 5, None, None)]
    df = spark.createDataFrame(rows, CHAT).withColumns({c: F.lit(-1) for c in ("conv", "none", "block", "place", "part", "complete", "turns", "loss", "number", "cut")})
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(chat_format.examples(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv] == chat_digest([(r, x) for _, r, x in own])
    sizes = chat_format.blocks(df).select(F.size("turns").alias("n")).agg(F.max("n")).first()[0]
    assert sizes <= 300


def test_chat_moves_each_text_a_few_times_only(spark):
    turns = spark.createDataFrame([(c, k, ("user", "assistant")[k % 2], f"{c} {k} " + "words and more " * 40) for c in range(40) for k in range(60)], CHAT)
    plan = chat_format.digests(chat_format.examples(turns))
    # what is aggregated by conversation is an example's length and its own text, not all prefixes
    moved = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "complete" in moved and plan.count() == 40


def licenses(spark, rows, **more):
    files = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit(v) for c, v in more.items()})
    out = license_scan.scan(files)
    assert out.columns[: 2 + len(more)] == ["path", "text", *more]
    return {r.path: (r.own_license, r.license, r.license_from) for r in out.collect()}


def test_licences_go_down_to_the_nearest_directory(spark):
    mit, isc = (next(t for name, t in TEMPLATES if name == k and len(t) > 300) for k in ("MIT", "ISC"))
    got = licenses(spark, [("LICENSE", f"MIT License\n\nCopyright (c) 2020 Somebody\n\n{mit}"), ("a/x.c", "int x;"), ("a/b/COPYING.txt", isc), ("a/b/y.c", "int y;"), ("a/b/c/d/z.c", "int z;"), ("a/bc/z.c", ""), ("a/b/own.c", "// SPDX-License-Identifier: Apache-2.0\nint o;"), ("e/LICENSE", "nothing here"), ("e/f.c", None)], folder=1, above=2, given=3, __content=4, __folder=5)
    assert got["LICENSE"] == ("MIT", "MIT", None) and got["a/b/COPYING.txt"] == ("ISC", "ISC", None)
    assert got["a/x.c"] == (None, "MIT", "") and got["a/bc/z.c"] == (None, "MIT", "") and got["e/f.c"] == (None, "MIT", "")
    assert got["a/b/y.c"] == (None, "ISC", "a/b") and got["a/b/c/d/z.c"] == (None, "ISC", "a/b")
    assert got["a/b/own.c"] == ("Apache-2.0", "Apache-2.0", None)
    rows = license_scan.scan(spark.createDataFrame([(None, "Released under the MIT License."), (None, "x"), ("x/LICENSE", "All rights reserved.")], "path string, text string")).collect()
    assert Counter((r.path, r.license, r.license_from) for r in rows) == Counter([(None, "MIT", None), (None, None, None), ("x/LICENSE", "all-rights-reserved", None)])


def test_licence_headers_and_both_sides_of_the_threshold(spark):
    """Scores equal those of every piece compared with every template, without the bounds."""
    mpl = " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/.\n"
    gpl = next(t for name, t in TEMPLATES if name == "GPL-3.0" and len(t) > 300)
    rng = random.Random(2)
    wrapped = re.sub(r"(.{50,60}) ", r"\1\n# ", gpl)
    texts = [f"/*\n{mpl} */\n\nint main() {{}}\n", f"# {wrapped}\n\nimport os\n", "the house and the dog\n" * 5, "", None, "License", "Version 2.0 of the story began in January.", "Permission is hereby granted to enter the house."]
    for name, text in TEMPLATES:
        words = text.split()
        for share in (0.3, 0.5, 0.7, 0.9):
            texts.append(" ".join(w if rng.random() < share else rng.choice("house tree river walk green".split()) for w in words))
    files = spark.createDataFrame([(f"d/{k}.c", t) for k, t in enumerate(texts)], "path string, text string")
    got = {r.path: (r.own_license, r.score) for r in license_scan.scan(files).collect()}
    n, term = len(texts), lambda t: re.findall("[a-z0-9]+", t.lower())
    df = Counter(w for t in texts for w in set(term(t or "")))
    idf = lambda w: math.log(1 + n / (1 + df.get(w, 0)))
    vector = lambda t: {w: c * idf(w) for w, c in Counter(term(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [(name, vector(t)) for name, t in TEMPLATES]
    hits = 0
    for k, text in enumerate(texts):
        text = text or ""
        best = []
        for piece in {text, *re.split("\n[ \t\r]*\n", text), *text.split("\n"), *re.split(r"\. |\n", text)}:
            v = vector(piece)
            if v:
                best += [(-round(sum(x * t.get(w, 0) for w, x in v.items()) / (norm(v) * norm(t)), 6), name) for name, t in templates]
        best = min((b for b in best if -b[0] >= license_scan.COSINE), default=None)
        want = (best[1], -best[0]) if best else (None, None)
        assert got[f"d/{k}.c"][0] == want[0] and (want[1] is None or abs(got[f"d/{k}.c"][1] - want[1]) < 2e-6), (k, text[:80])
        hits += best is not None
    assert got["d/0.c"][0] == "MPL-2.0" and got["d/1.c"][0] == "GPL-3.0" and 30 < hits < n - 20


def test_further_secrets_and_their_redaction(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc+/=\n-----END RSA PRIVATE KEY-----"
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    text = f"é {key} and {token} or ghp_{'a1' * 20}, password=abcdef12 end"
    kinds = [k for k, *_ in secret_scan.find_spans(text)]
    assert {"private_key", "web_token", "prefixed", "assign"} <= set(kinds)
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (2, "clean", 5), (None, f"x {token}", None), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long").withColumns({"__spans": F.lit(1), "__blob": F.lit(2), "spans": F.lit(3), "blob": F.lit(4)})
    rows = secret_scan.redact(docs).collect()
    clean = "é [secret] and [secret] or [secret], [secret] end"
    assert Counter((r.doc_id, r.text, r.n_chars) for r in rows) == Counter([(1, clean, len(clean)), (1, clean, len(clean)), (2, "clean", 5), (None, "x [secret]", 10), (3, None, None), (4, "", 0)])


def test_redaction_of_many_spans_is_linear():
    text = "password=abcdef12 " * 20_000
    spans = [{"kind": k, "start": a, "end": b} for k, a, b in secret_scan.find_spans(text)]
    began = time.perf_counter()
    assert secret_scan.cleaned(text, spans) == "[secret] " * 20_000 and len(spans) == 20_000
    assert time.perf_counter() - began < 1
    assert secret_scan.cleaned("abcdefgh", [{"start": 1, "end": 4}, {"start": 2, "end": 6}, {"start": 3, "end": 5}, {"start": 7, "end": 8}]) == "a[secret]g[secret]"


def test_ledger_of_a_saved_table_spares_known_blobs(spark, tmp_path, monkeypatch):
    schema = "doc_id long, text string"
    _, ledger = secret_scan.scan(spark.createDataFrame([(k, f"token: abcdef{k}") for k in range(20)], schema))
    ledger.write.parquet(str(tmp_path / "ledger"))
    kept = spark.read.parquet(str(tmp_path / "ledger"))
    later = spark.createDataFrame([(k, f"token: abcdef{k % 25}") for k in range(60)], schema)
    scanned, real = [], secret_scan._scanned
    monkeypatch.setattr(secret_scan, "_scanned", lambda df: (scanned.append(df), real(df))[1])
    found, after = secret_scan.scan(later, kept)
    assert scanned[0].select("blob").distinct().count() == 5 and after.count() == 25
    assert all(len(r.spans) == 1 for r in found.collect()) and found.count() == 60


def recurring(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in line_dedup.dedup(docs).collect()}


@pytest.mark.parametrize("a,b,c", [(10, 0, 0), (10, 10, 0), (10, 6, 0), (10, 10, 10), (12, 5, 3)])
def test_a_leaf_holds_several_templates(spark, a, b, c):
    names = [f"{x}{y}{z}" for x in "abcd" for y in "efgh" for z in "ijkl"]
    forms = [("The user account {} was created today", a), ("The user account {} has expired yesterday", b), ("The user account of {} is open", c)]
    texts = [f.format(names[k]) for f, n in forms for k in range(n)]
    texts += ["He did not know where to go then", "He did not want any more of it", "He did not see her old house again"]
    dropped = recurring(spark, [(k, f"own words {names[k]} {names[-k]}\n{t}") for k, t in enumerate(texts)])
    n = a + b + c
    assert sum(dropped[k] for k in range(n)) == sum(x - 1 for x in (a, b, c) if x)
    assert not any(dropped[k] for k in range(n, len(texts)))


@pytest.mark.parametrize("n,days", [(17, 0), (40, 0), (1000, 0), (60, 7)])
def test_templates_are_found_whatever_the_size_of_their_leaf(spark, n, days):
    """n templates of ten lines in one leaf, each with a field of its own and, where days is set, one of so many values."""
    day = lambda k: f"day{'abcdefghij'[k % days]}" if days else "today"
    word = lambda k: "".join("abcdefghij"[int(d)] for d in str(k))
    rows = [(10 * t + k, f"own {word(10 * t + k)}\nthe big system reports module{word(t)} part{word(t)} value {word(31 * t + 7 * k + k * k)}v on {day(k + t)} from unit{word(t)} again{word(t)}") for t in range(n) for k in range(10)]
    dropped = recurring(spark, rows)
    assert sum(dropped.values()) == 9 * n and all(dropped[10 * t] == 0 for t in range(n))


def test_lines_of_long_and_repeated_texts(spark):
    long = "\n".join(["Read more of this here today", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} only once here" for k in range(20_000))])
    rows = [(1, long)] * 3 + [(2, "Read more of this here today\nown line of two"), (3, "Read more of this here today"), (4, "Read more of this here today\nanother own line")]
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("i", "line", "leaf", "full", "w", "grp", "copy")}))
    got = Counter((r.doc_id, r.n_dropped, r.text if r.doc_id > 1 else len(r.text)) for r in out.collect())
    assert got == Counter([(1, 0, len(long))] * 3 + [(2, 1, "own line of two"), (3, 1, ""), (4, 1, "another own line")])


def rows_shared(texts, width=4, numerator=85):
    """Largest class of texts by shared rows of the matrix."""
    root, having = list(range(len(texts))), {}

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for k, t in enumerate(texts):
        for row in jaccard_join.rows(jaccard_join.shingles(t.encode(), width), numerator).tolist():
            root[find(k)] = find(having.setdefault(row, k))
    return max(Counter(map(find, range(len(texts)))).values())


@pytest.mark.parametrize("width,numerator", [(4, 85), (5, 80)])
def test_unrelated_short_texts_stay_apart_at_any_number(width, numerator):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    for n in (2000, 8000, 16000):
        assert rows_shared([" ".join(rng.choice(words) for _ in range(rng.randint(6, 20))) for _ in range(n)], width, numerator) <= 4


def test_sets_dealt_anew_still_meet():
    """With all n-grams in one part of the first deal, only the next deals can show what is equal."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        tokens = np.unique(rng.choice(1 << 30, 13, replace=False).astype(np.uint64)) * np.uint64(60) << np.uint64(20)
        less = np.delete(tokens, rng.integers(len(tokens)))
        a, b = jaccard_join.rows(tokens), jaccard_join.rows(less)
        assert len(np.intersect1d(a, b))


def test_large_cluster_meets_in_blocks_that_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 100)
    compared = []
    real = jaccard_join.members
    monkeypatch.setattr(jaccard_join, "members", lambda docs, placed, width: (compared.append(placed.count()), real(docs, placed, width))[1])
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    for n in (600, 2400):
        texts = {}
        for k in range(n):
            words, at = list(base), rng.randrange(4, 60)
            words[at] = f"x{rng.randrange(10**6)}"
            texts[k] = " ".join(words if k else base)
        texts[n] = "quite another text that is alone here"
        compared.clear()
        got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert got[n] == n and Counter(got.values())[0] >= 0.95 * n
        assert max(compared) <= n + (jaccard_join.PIVOTS + 1) * (n // 100 + 2) and sum(compared) <= 3.3 * n  # linear
        if n == 600:
            assert got == {d: c for d, (_, c) in linked_classes(texts).items()}


def test_documents_outside_the_largest_class_reach_other_blocks(spark, monkeypatch):
    """Chains of copies: neighbours are linked, ends aren't, and the pivots meet few of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 7)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    texts, words = {}, [f"w{k}" for k in range(80)]
    for k in range(90):
        words[k % 80] = f"new{k}"
        texts[k] = " ".join(words)
    texts |= {200 + k: " ".join(f"v{j}" if j != 7 * k % 60 else f"z{k}" for j in range(60)) for k in range(30)}
    want = {d: c for d, (_, c) in linked_classes(texts).items()}
    got = {r.doc_id: r.component_id for r in jaccard_join.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_repeated_ids_in_the_join(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, a), (5, b), (3, a), (9, b), (9, b), (None, a), (7, None), (8, " ")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(5, 4, 3), (5, 3, 5), (3, 4, 3), (9, 3, 5), (9, 3, 5), (None, 4, None), (7, 0, 7), (8, 0, 8)])


def test_equal_pieces_of_one_id_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = [(None if k % 2 else 7, "the same words") for k in range(400)] + [(k, f"word{k}") for k in range(50)]
    cut = packing.saved(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), registry.tokenizer_path("word_bpe_49k.json")))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    ranked = packing.ranked(cut, counts).collect()
    for n, c in counts.items():
        assert sorted(r["rank"] for r in ranked if r["length"] == n) == list(range(c))
    shares = packing.ranked(cut, counts)._jdf.queryExecution().toString()
    assert "place" in shares
    dealt = cut.filter("doc_id = 7").select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(20)).alias("s")).groupBy("s").count().collect()
    assert len(dealt) > 10


def test_other_vocabularies_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    assert packing.WordTokenizer(path).words.known
    other = packing.WordTokenizer(registry.tokenizer_path("byte_bpe_50k.json"))
    assert not other.words.known
    text = "Hello  world\n<|endoftext|> é"
    assert np.frombuffer(other.encode([text])[0], "<u4").tolist() == Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def naive_isotonic(y, w):
    """Least squares under rising order, by the min-max formula."""
    n = len(y)
    mean = lambda a, b: np.dot(y[a : b + 1], w[a : b + 1]) / w[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_equals_the_min_max_formula():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(1, 12))
        w, y = rng.integers(1, 6, n).astype(float), rng.random(n)
        knots, levels = quality_classifier.isotonic(np.arange(n, dtype=float), y * w, w)
        assert np.allclose(np.interp(np.arange(n), knots, levels), naive_isotonic(y, w))


def test_classifier_sums_equal_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, d = 400, len(quality_classifier.NAMES)
    f = rng.normal(size=(n, d))
    y = (f[:, 0] + 0.5 * f[:, 1] > 0).astype(int)
    stats = spark.createDataFrame([(k, f[k].tolist()) for k in range(n)], "doc_id long, f array<double>").repartition(5)
    labels = spark.createDataFrame([(k, int(y[k])) for k in range(n)], "doc_id long, quality int")
    model = quality_classifier.fit(stats, labels, cosines=32)
    import zlib

    fold = np.array([zlib.crc32(str(k).encode()) % 5 for k in range(n)])
    train = (fold != quality_classifier.HELD_OUT) & (fold != quality_classifier.CALIBRATION)
    assert np.allclose(model.mean, f[train].mean(0)) and np.allclose(model.scale, f[train].std(0))
    z = model.features(f[train])
    a = z.T @ z + quality_classifier.RIDGE * train.sum() * np.diag([1.0] * 32 + [0.0])
    assert np.allclose(model.weights, np.linalg.solve(a, z.T @ y[train]), atol=1e-6)
    held = fold == quality_classifier.HELD_OUT
    raw, score = model.raw(f[held]), model.score(f[held])
    up, down = raw[y[held] == 1], raw[y[held] == 0]
    assert (up[:, None] > down[None]).mean() > 0.85 and ((score >= 0) & (score <= 1)).all()
    # the approximated kernel is near the Gaussian one
    many = quality_classifier.fit(stats, labels, cosines=4096)
    some = f[:20]
    wave = many.features(some)[:, :-1]
    z = np.clip((some - many.mean) / many.scale, -8, 8)
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(wave @ wave.T - kernel).max() < 0.1


def test_shouts_count_on_the_text(spark):
    rows = quality_rules.counts(spark.createDataFrame([("a! !b ok",), ("a!! b",), (None,)], "text string").withColumns({"__w": F.lit(1), "__j": F.lit(2)})).collect()
    assert [r["n_shouts"] for r in rows] == [0, 1, 0] and [r["__w"] for r in rows] == [1, 1, 1]


def test_secrets_in_long_runs_take_linear_time():
    text = "eyJaaaaaaaa-" * 400_000
    began = time.perf_counter()
    assert secret_scan.find_spans(text) == []
    assert time.perf_counter() - began < 5
    token = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    assert [k for k, *_ in secret_scan.find_spans(f"a {token} b")] == ["web_token"] and secret_scan.find_spans(f"a-{token}") == []
