"""Queries against their SQL, and against plain Python where SQL can't say it."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import spark_rows, sql_rows  # noqa: E402

from geolode.llm import registry  # noqa: E402

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(SQL[name], sf_dir)


def test_secrets_equal_plain_scan(spark, sf_dir, texts):
    from geolode.llm.secret_scan import BASE

    rows = {r.doc_id: r for r in QUERIES["op5_secret_scan"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        found = []
        for order, (kind, (pattern, group, least)) in enumerate(BASE.items()):
            found += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}", kind) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        r, n = rows[doc_id], Counter(f[3] for f in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest()


def test_all_kinds_of_secrets_equal_plain_patterns(spark, sf_dir, texts):
    from geolode.llm.secret_scan import RULES

    rows = {r.doc_id: r.spans for r in QUERIES["op5_secret_scan"](spark, sf_dir).collect()}
    for doc_id, text in texts.items():
        found = [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for order, (kind, (pattern, group, least)) in enumerate(RULES.items()) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
        assert rows[doc_id] == ",".join(f[2] for f in sorted(found))


def test_media_round_trip(spark, sf_dir, texts):
    rows = {r.doc_id: r for r in QUERIES["op6_progressive_jpeg"](spark, sf_dir).collect()}
    assert rows.keys() == texts.keys()
    same = defaultdict(set)
    for doc_id, text in texts.items():
        raw = text.encode()
        payload, r = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"), rows[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        same[text].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())


def test_packing_is_best_fit_decreasing(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json"))
    want, lengths = {}, []
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[doc_id, k // 2048] = (k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes()))
            lengths.append(len(ids[k : k + 2048]))
    rows = QUERIES["op8_best_fit_packing"](spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((2048 if fit is None else fit) - n)
    assert sorted(2048 - sum(n for _, n in p) for p in bins.values()) == sorted(rooms)


def test_pieces_equal_the_library(spark, sf_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect():
        ids = [model.bos_id(), *model.encode(texts[r.doc_id], num_threads=1), model.eos_id()]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def linked_classes(texts, width=4, numerator=85, denominator=100):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root, having = {d: d for d in sets}, defaultdict(list)

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in having[s])
        for e, n in common.items():
            if denominator * n >= numerator * (len(sets[d]) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
        for s in sets[d]:
            having[s].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_jaccard_classes_equal_brute_force(spark, sf_dir, texts):
    rows = QUERIES["op7_jaccard_join"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == linked_classes(texts)


def test_classifier_on_held_out_labels(spark, sf_dir):
    sf_dir = str(Path(sf_dir).parent / "sf0.01")  # the smallest table has too few held-out labels
    rows = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, sf_dir).collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [rows[d].predicted == q for d, q in labels if rows[d].held_out]
    assert len(held) > 50 and sum(held) >= 0.97 * len(held)
