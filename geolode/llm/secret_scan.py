"""Secret scans with an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its content. A ledger says which (blob, rule version) pairs were
scanned and what was found. A scan takes one representative of each blob that the ledger lacks, so copies and old versions
cost nothing, and joins the findings back to all paths that hold the blob.

Only addresses are grouped, never texts of one blob: a group of copies, however large, is folded before the shuffle. Texts move
once, to the join with the blobs to scan; with a ledger of most blobs these are few and go to the texts instead, if their measured size allows.
Repeated rows of one key and blob arrive next to each other and are scanned once. Null text counts as empty; an empty text has no findings. Repeated rows each get the findings of
their blob; rows with a null key too. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import few, saved, small_side

#: Kinds in the order in which equal starts are listed: pattern, group that is measured, its least length (fixed values).
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Further spans. A web token begins where its run of letters does, so that a run is tried once, however long; one right behind a letter, digit, ``_`` or ``-`` doesn't count.
MORE = {
    "private_key": (r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", 0, 1),
    "web_token": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "prefixed": (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,})", 0, 1),
}
RULES = BASE | MORE
RULE_VERSION = hashlib.sha256(repr(sorted(RULES.items())).encode()).hexdigest()[:16]

#: Texts without any of these (in lower case) can't match a rule, but for hex, which has a pattern of its own.
_HINTS = {"assign": ("passw", "secret", "token", "key"), "access": ("akia",), "private_key": ("-----begin",), "web_token": ("eyj",), "prefixed": ("gh", "xox", "sk_live_")}
#: The same spans as RULES gives; runs of hex digits are whole either way.
_FOUND = {k: re.compile(p if k != "hex" else r"[0-9a-f]{24,}", re.ASCII) for k, (p, _, _) in RULES.items()}

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, the end exclusive, by start and then by kind as listed."""
    low, found = text.lower(), []
    for order, (kind, (_, group, least)) in enumerate(RULES.items()):
        if kind not in _HINTS or any(h in low for h in _HINTS[kind]):
            found += [(m.start(), order, kind, m.end()) for m in _FOUND[kind].finditer(text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _scanned(blobs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in few(batches):
            found, spans = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob != last:
                    last = blob
                    found.append(blob)
                    spans.append([{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text.as_py() or "")])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(spans, kind)], ["blob", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, f"blob binary, spans {SPANS}")


def _hits_side(hits: DataFrame) -> DataFrame:
    """hits, with a broadcast hint if its measured size allows."""
    n, spans = hits.agg(F.count("*"), F.sum(F.size("spans"))).first()
    return small_side(hits, 80 * n + 40 * (spans or 0), 1)


def scan(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings (key, blob, spans; a row per version) and the ledger (blob, rule_version, spans) with the new scans.

    versions has a row for each path and version; key names them. Pass the ledger of the last scan to scan only what is new.
    """
    addressed = versions.select(F.col(key).alias("key"), F.col(text).alias("text"), address(F.col(text)).alias("blob"))
    paths = saved(addressed.select("key", "blob"))
    unseen = paths.groupBy("blob").agg(F.min("key").alias("first"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti")
    unseen = saved(unseen.withColumnRenamed("blob", "wanted"))
    # each blob once: the rows of its first key
    wanted = unseen.hint("merge") if ledger is None else small_side(unseen, unseen.count(), 60)
    rows = addressed.join(wanted, F.col("key").eqNullSafe(F.col("first")) & (F.col("blob") == F.col("wanted")), "left_semi")
    new = _scanned(rows).dropDuplicates(["blob"]).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "spans")
    new = saved(new)
    whole = new if ledger is None else ledger.unionByName(new)
    hits = whole.filter((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0)).select("blob", "spans")
    found = paths.join(_hits_side(hits), "blob", "left")
    none = F.array().cast(SPANS)
    return found.select(F.col("key").alias(key), "blob", F.coalesce("spans", none).alias("spans")), whole


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """found with n_assign, n_access, n_hex, base_sha256 and spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = {f"n_{k}": F.size(of_kind(k)).cast("long") for k in BASE}
    return found.withColumns(counts | {"base_sha256": F.sha2(listed(base), 256)}).withColumn("spans", listed(F.col("spans")))


MARK = "[secret]"


def cleaned(text: str, spans: list[dict]) -> str:
    """text with MARK for each run of spans that overlap; spans by start. One pass, whatever their number."""
    out, at = [], 0
    for k, span in enumerate(spans):
        if k and span["start"] < at:
            at = max(at, span["end"])
            continue
        out += [text[at : span["start"]], MARK]
        at = span["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets in text replaced by a mark and n_chars set anew where the text changed; all columns and rows stay."""
    found, _ = scan(docs)
    hits = saved(found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]))
    # columns of the join that no column of docs is named like
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    side = _hits_side(hits).withColumnsRenamed({"blob": f"{mark}blob", "spans": f"{mark}spans"})
    joined = docs.join(side, address(F.col("text")) == F.col(f"{mark}blob"), "left").select(*docs.columns, f"{mark}spans")
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            spans, rest = batch.column(batch.num_columns - 1), batch.columns[:-1]
            if spans.null_count < len(spans):
                texts = [cleaned(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(rest[at], spans, strict=True)]
                if count is not None:
                    rest[count] = pa.array([len(t) if s.is_valid else n.as_py() for n, t, s in zip(rest[count], texts, spans, strict=True)], rest[count].type)
                rest[at] = pa.array(texts, rest[at].type)
            yield pa.RecordBatch.from_arrays(rest, names)

    return joined.mapInArrow(run, docs.schema)
