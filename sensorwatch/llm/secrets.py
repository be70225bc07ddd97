"""Secret scan with corpus-wide ownership frequency.

Candidates come from fixed patterns (assignments, access ids, long hexadecimal runs, whole private
keys, bare high-entropy strings). Their value hashes are counted over the whole corpus by
distinct repositories and owners: a value seen under many owners is a widely copied example, one
that stays with its owner looks live. Base patterns are always reported; bare strings only where
their value is owner-specific.

A private key runs from its BEGIN line to its END line only if nothing but headers, base64 text and
joints of string literals stands between; prose that names both lines holds no key.

Repository is a column (``source``); its owner is what stands before the first "/", the whole name
without one. Rows without a repository count as one repository of one unknown owner. A null text
counts as empty, an empty table gives an empty result, repeated rows are rows of their own, and input
columns may have any names. A text of any length is scanned whole, in time linear in it. Counting adds up map-side first, so a value that a third of all documents share is
a few rows per task; texts are not shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from hashlib import blake2b, sha256
from itertools import accumulate
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorwatch.llm import common as C

# The base patterns, in reporting order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "private_key", "bare"]
BASE = 3
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
# Without an END line: headers, then lines (or escaped lines) of base64 and a last, shorter one.
KEY_BODY = re.compile(r"""(?:\s*[A-Z][A-Za-z-]+:\x20[^\n]*\n)*(?:(?:(?:\\[nr]|[\s"'+,>#*|])*[A-Za-z0-9+/]{20,}={0,2})+(?:(?:\r?\n|\\n)[\x20\t]*[A-Za-z0-9+/]+={0,2}(?=\s|\\|["']|$))?)?""")
KEY_HEADER = re.compile(r"""(?:\\[nr]|[\s"'+,>#*|])*[A-Z][A-Za-z-]+:\x20(?:(?!\\n)[^\n])*(?:\n|\\n)""")
KEY_BREAK = re.compile(r"""(?:\\[nrt]|[\s"',>#*|]|(?<=["'\s])\+(?=["'\s]))+""")
KEY_LINE = re.compile(r"[A-Za-z0-9+/]+={0,2}")
KEY_JOINTS = re.compile(r"""\\[nrt]|["']\s*\+\s*["']|[^A-Za-z0-9+/=]+""")
BARE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


@dataclass(frozen=True)
class SecretConfig:
    owners: int = 2  # a value under more owners is a copied example
    entropy: float = 3.6  # bits per character of a bare string, at least


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in map(value.count, set(value)))


def is_key_body(text: str, low: int, high: int) -> bool:
    """Whether a span holds headers, then lines of base64 text (16 characters or more but for the last), and nothing else."""
    while header := KEY_HEADER.match(text, low, high):
        low = header.end()
    lines = [x for x in KEY_BREAK.split(text[low:high]) if x]
    return bool(lines) and len(lines[0]) >= 16 and all(KEY_LINE.fullmatch(x) and len(x) >= 16 for x in lines[:-1]) and bool(KEY_LINE.fullmatch(lines[-1]))


def private_keys(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value): through the END line if a key stands before it, or else to the end of the base64 text; the value is the whole body without white space and escapes, empty without a key."""
    found = []
    for m in PRIVATE_KEY.finditer(text):
        bound = text.find("-----BEGIN", m.end())
        bound = len(text) if bound < 0 else bound
        last = KEY_END.search(text, m.end(), bound)
        upto, end = last.span() if last and is_key_body(text, m.end(), last.start()) else [KEY_BODY.match(text, m.end(), bound).end()] * 2
        found.append((m.start(), end, KEY_JOINTS.sub("", text[m.end() : upto])))
    return found


def candidates(text: str, cfg: SecretConfig = SecretConfig()) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind; ends exclusive, in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(3, *k) for k in private_keys(text) if k[2]]
    taken = sorted((s, e) for _, s, e, _ in found)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))  # furthest end so far
    for m in BARE.finditer(text):
        value = m[0]
        if not (value.isalpha() or value.isdigit()) and any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value:
            before = bisect_left(starts, m.end())
            if not (before and reach[before - 1] > m.start()) and _entropy(value) >= cfg.entropy:
                found.append((4, m.start(), m.end(), value))
    return sorted(found, key=lambda c: (c[1], c[0]))


def _digest(value: str) -> int:
    return int.from_bytes(blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


ROW = "doc_id long, row long, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,at:int,value:long>>"


def scanned(docs: DataFrame, cfg: SecretConfig, key: str, text: str, repository: str, carry: bool = False) -> DataFrame:
    """Candidates of every document, values as hashes; ``carry`` keeps the document's columns in ``document``."""

    def scan(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, digests, flat, cuts = [], [], [], [0]
        for x in C.python_texts(batch.column(3)):
            own = candidates(x, cfg)
            counts.append([sum(c[0] == k for c in own) for k in range(BASE)])
            digests.append(sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in own if k < BASE).encode()).hexdigest())
            flat += [(s, k, e, s if KINDS[k] == "private_key" else e - len(v), _digest(v)) for k, s, e, v in own]
            cuts.append(len(flat))
        columns = list(zip(*flat, strict=True)) or [[]] * 5
        struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["start", "kind", "end", "at", "value"])
        n = np.array(counts, np.int64).reshape(-1, BASE)
        return [batch.column(0), batch.column(1), batch.column(2), *[pa.array(n[:, k]) for k in range(BASE)], pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), struct), *batch.columns[4:]]

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), F.col(text).alias("text"), *[F.struct("*").alias("document")] * carry)
    schema = StructType(list(StructType.fromDDL(ROW).fields))
    return C.map_arrow(rows, scan, schema.add("document", StructType(list(docs.schema.fields))) if carry else schema)


def ownership(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners and repositories and the number of candidates."""
    owner = F.substring_index("repository", "/", 1)
    by_repository = found.groupBy("value", owner.alias("owner"), "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("seen"))


def secrets(docs: DataFrame, cfg: SecretConfig = SecretConfig(), key: str = "doc_id", text: str = "text", repository: str = "source") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, found (array of start, kind, end, value,
    owners, repositories, seen, live, by start and kind)."""
    return judged(scanned(docs, cfg, key, text, repository), cfg)


def judged(scan: DataFrame, cfg: SecretConfig) -> DataFrame:
    """Decide every candidate by its value's ownership; documents without candidates are not shuffled."""
    rows = C.written(scan, "scan")
    some = rows.where("size(found) > 0").select("row", "repository", F.explode("found").alias("f")).select("row", "repository", "f.*")
    live = F.col("owners") <= cfg.owners
    spans = some.join(ownership(some), "value").withColumn("live", live).where((F.col("kind") != KINDS.index("bare")) | live)
    kinds = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", kinds.alias("name"), "end", "at", "value", "owners", "repositories", "seen", "live"))).alias("found"))
    out = [c for c in rows.columns if c not in ("row", "repository")]
    none = F.array().cast(spans.schema["found"].dataType)
    with_some = rows.where("size(found) > 0").drop("found").join(spans, "row", "left").withColumn("found", F.coalesce("found", none)).select(*out)
    return with_some.union(rows.where("size(found) = 0").withColumn("found", none).select(*out))


def redacted(docs: DataFrame, cfg: SecretConfig = SecretConfig(), key: str = "doc_id", text: str = "text", repository: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The documents with the value of every live-looking credential replaced; copied examples stay. Columns as before."""
    rows = judged(scanned(docs, cfg, key, text, repository, carry=True), cfg)
    place, live = docs.columns.index(text), C.fresh(docs, "_live")
    spot = F.transform(F.filter("found", lambda f: f["live"]), lambda f: F.struct(f["at"], f["end"]))
    rows = rows.select("document.*", F.array_sort(spot).alias(live))
    clean, dirty = rows.where(F.size(live) == 0).drop(live), rows.where(F.size(live) > 0)

    def redact(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = []
        for x, spots in zip(C.python_texts(batch.column(place)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            parts, low = [], 0
            for s in spots:
                if s["at"] >= low:
                    parts += [x[low : s["at"]], mark]
                low = max(low, s["end"])
            texts.append("".join([*parts, x[low:]]))
        columns = batch.columns[:-1]
        columns[place] = pa.array(texts, pa.string())
        return columns

    return clean.union(C.map_arrow(dirty, redact, StructType(list(docs.schema.fields))))
