"""Secret scans with corpus-wide ownership frequency.

A scan of each text gives base spans of three kinds and candidates of more
kinds: other forms of credentials, and near misses of the base (upper-case hex,
short assigned values, quoted values behind other key words).  Hashes of all of
them are counted over the corpus by distinct repositories and owners: a value
that many owners share is a copied example, a value of one or two owners looks
live.  Only live candidates become further spans; base spans are always kept,
and the counts mark them live or copied.

Edge cases: null and empty texts have no spans; equal spans of different kinds
each count; a candidate inside a base span adds nothing and is left out; a null
owner or repository counts as one of its own; repeated rows of one document are
one owner's; columns named as those that are added are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, in_small_batches, stored

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Kinds in the order in which equal starts are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "bearer", "prefixed", "dsn", "private_key", "jwt", "upper_hex", "short_assign", "keyed"]
# Forms of further credentials.
MORE = {
    "bearer": re.compile(r"\b[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,}=*)"),
    "prefixed": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|glpat-[A-Za-z0-9_-]{20,})"),
    # long schemes start at one place only, and runs give nothing back: time stays linear
    "dsn": re.compile(r"(?:\b[a-z][a-z0-9+]{1,20}|(?<![a-z0-9+])[a-z][a-z0-9+]{21,}+)://[^\s:/@]++:([^\s@/]{6,}+)@"),
    # header lines as Proc-Type and DEK-Info may come before the key
    "private_key": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*+(?:[A-Za-z][A-Za-z0-9-]*+:(?:[^\n-]|-(?!----))*+\n)++)?+[A-Za-z0-9+/=\s]{32,}+-----END [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "upper_hex": re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*+[A-F])(?=[A-F]*+[0-9])[0-9A-F]{32,}+(?![0-9A-Za-z])"),
    "short_assign": re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]{6,7})(?![A-Za-z0-9+/_.=-])""", re.ASCII),
    "keyed": re.compile(r"""(?i:pwd|pass_?phrase|private_?key|access_?key|credentials?|auth)["']?\x20*+[:=]\x20*+["']([A-Za-z0-9+/_.=-]{12,}+)["']""", re.ASCII),
}
#: One of these, in lower case, stands in every text with a span of the kind.
_NEEDLES = {
    "bearer": ("bearer",), "prefixed": ("gh", "xox", "sk_live_", "aiza", "glpat-"), "dsn": ("://",), "private_key": ("private key",), "jwt": ("eyj",), "upper_hex": ("a", "b", "c", "d", "e", "f"),
    "short_assign": ("passw", "secret", "token", "api"), "keyed": ("pwd", "phrase", "key", "credential", "auth"),
}
#: Owners from which on a value is a copied example.
SHARED_OWNERS = 3
#: Bits a character below which a candidate is a placeholder.
MIN_ENTROPY = 2.5

_HEX_MARK = bytes(0x68 if chr(i) in "0123456789abcdef" else 0x20 for i in range(256))
_UPPER_MARK = bytes(0x68 if chr(i) in "0123456789ABCDEF" else 0x20 for i in range(256))
_HEX_RUN = b"h" * 32


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base, by start, then in the order of KINDS."""
    out = []
    low = text.lower()
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_MARK):
        out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return _ordered(out)


def candidate_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Further candidates, which the corpus decides on; none inside a base span or, for near misses, another candidate."""
    out: list[tuple[int, int, str, str]] = []
    low = text.lower()
    upper = _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_UPPER_MARK)
    held = _Cover(base)
    for kind, pattern in MORE.items():
        if kind == "upper_hex":
            held = _Cover(_ordered([*base, *out]))
        if (kind != "upper_hex" or upper) and any(x in low for x in _NEEDLES[kind]):
            for m in pattern.finditer(text):
                value = m[1] if pattern.groups else m[0]
                if entropy(value) >= MIN_ENTROPY and not held.has(m.start(), m.end()):
                    out.append((m.start(), m.end(), kind, value))
    return _ordered(out)


class _Cover:
    """Whether a span lies in one of others, which come by start."""

    def __init__(self, spans: list[tuple[int, int, str, str]]):
        self.starts = [s[0] for s in spans]
        self.furthest = list(itertools.accumulate((s[1] for s in spans), max))

    def has(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start)
        return at > 0 and self.furthest[at - 1] >= end


def _ordered(spans: list) -> list:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def digest(spans: Iterable[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


SPAN = "array<struct<kind:string,start:long,end:long,value:binary>>"
FIELDS = f"__base {SPAN}, __more {SPAN}"
#: Spans of find_secrets.
MARKED = "array<struct<kind:string,start:long,end:long,value:binary,owners:long,repositories:long,live:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.binary())]))


def _found(spans: list) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16]} for s, e, k, v in spans]


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` (with names of their own) followed by FIELDS; values are hashed and never leave the task in clear."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for value in batch.column(text):
                own = value.as_py() or ""
                spans = base_spans(own)
                base.append(_found(spans))
                more.append(_found(candidate_spans(own, spans)))
            arrays = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(base, _ARROW), pa.array(more, _ARROW)], names=[*keep, "__base", "__more"])

    columns = list(dict.fromkeys([*keep, text]))
    return in_small_batches(docs).select(*columns).mapInArrow(rows, extended(docs.select(*keep).schema, FIELDS))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories: distinct counts over the corpus, first made distinct so that a hot value shrinks in the tasks."""
    seen = found.select(F.explode(F.concat("__base", "__more")).alias("span"), "__owner", "__repository")
    places = seen.select("span.value", F.coalesce("__owner", F.lit("")).alias("owner"), F.coalesce("__repository", F.lit("")).alias("repository")).distinct()
    by_owner = places.groupBy("value", "owner").agg(F.count("*").alias("places"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("places").alias("repositories"))


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", owner: str = "source", repository: str = "source", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """One row per row of ``docs``: ``keep``, base spans, and added spans (live-looking candidates of further kinds).

    Spans of both carry the hash, owners and repositories of their value, and
    whether it looks live; base spans stay where it is a copied one.  A repository
    is one of an owner's; where only one of the two is known, both are it.
    """
    keep = [c for c in dict.fromkeys(keep) if c not in ("base", "added")]
    own = docs.select(*keep, docs[text].cast("string").alias("__text"), docs[owner].cast("string").alias("__owner"), docs[repository].cast("string").alias("__repository"))
    # row numbers are drawn once, in a written table
    found = stored(scan(own, [*keep, "__owner", "__repository"], "__text").withColumn("__row", F.monotonically_increasing_id()))
    counts = stored(ownership(found))  # written, so that the join has two plain exchanges and a hot value can be split
    some = F.size("__base") + F.size("__more") > 0
    spans = found.where(some).select("__row", F.size("__base").alias("n_base"), F.posexplode(F.concat("__base", "__more")).alias("at", "span")).select("__row", "n_base", "at", "span.*").join(counts, "value")
    spans = spans.withColumn("live", F.col("owners") < shared_owners)
    one = F.struct("at", "kind", "start", "end", "value", "owners", "repositories", "live")
    marked = spans.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.when(F.col("at") < F.col("n_base"), one))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("at") >= F.col("n_base")) & F.col("live"), one))).alias("added"),
    )
    names = [x.split(":")[0] for x in MARKED[len("array<struct<") : -2].split(",")]
    plain = [F.transform(c, lambda x: F.struct(*[x[n].alias(n) for n in names])).cast(MARKED).alias(c) for c in ("base", "added")]
    joined = found.where(some).select(*keep, "__row").join(marked, "__row").select(*keep, *plain)
    none = F.array().cast(MARKED)
    return joined.union(found.where(~some).select(*keep, none.alias("base"), none.alias("added")))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of the rows of find_secrets, then owners, repositories and mark (live or copied) of each of ``spans``."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = batch.column("base").to_pylist()
            added = batch.column("added").to_pylist()
            counts = np.array([[sum(s["kind"] == k for s in x) for k in KINDS[:3]] for x in base], np.int64).reshape(-1, 3)
            plain, more = ([[(s["start"], s["end"], s["kind"], s["owners"], s["repositories"], "live" if s["live"] else "copied") for s in x] for x in y] for y in (base, added))
            every = [_ordered(p + x) for p, x in zip(plain, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    *(pa.array(counts[:, i]) for i in range(3)),
                    pa.array([hashlib.sha256(digest(_ordered(p)).encode()).hexdigest() for p in plain], pa.string()),
                    pa.array([digest(e) for e in every], pa.string()),
                    *(pa.array([",".join(str(s[i]) for s in e) for e in every], pa.string()) for i in (3, 4, 5)),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "owners", "repositories", "marks"],
            )

    kind = found.schema[key].dataType.simpleString()
    return found.select(key, "base", "added").mapInArrow(rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, owners string, repositories string, marks string")


MASK = "[secret]"


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "source", shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """``docs`` with every base span and every live-looking span replaced by MASK; other columns stay."""
    shape = docs.schema
    prints = docs.select(docs[key].alias("__key"), F.xxhash64(docs[key], docs[text]).alias("__print"), docs[text].alias("__text"), docs[owner].alias("__of"), docs[repository].alias("__in"))
    found = find_secrets(prints, ["__key", "__print"], "__text", "__of", "__in", shared_owners)
    # written, so that its size is known: the texts themselves are only dealt anew if it is large
    added = stored(found.where(F.size("added") > 0).select("__key", F.col("__print").alias("__copy"), F.col("added").alias("__added")).dropDuplicates(["__key", "__copy"]))
    marked = docs.withColumn("__print", F.xxhash64(F.col(key), F.col(text)))
    joined = marked.join(added, marked[key].eqNullSafe(added["__key"]) & (marked["__print"] == added["__copy"]), "left").select(*docs.columns, "__added")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, more in zip(batch.column(text), batch.column("__added").to_pylist(), strict=True):
                own = value.as_py()
                spans = [(s, e) for s, e, *_ in base_spans(own)] + [(s["start"], s["end"]) for s in more or []] if own else []
                out.append(masked(own, spans))
            at = batch.schema.get_field_index(text)
            part = batch.drop_columns(["__added"])
            yield part.set_column(at, pa.field(text, pa.string()), pa.array(out, pa.string()))

    return joined.mapInArrow(rows, shape)


def masked(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text with merged spans replaced."""
    if not text or not spans:
        return text
    out, at, last = [], 0, -1
    for start, end in sorted(spans):
        if start > last:
            out += [text[at:start], MASK]
            last = at = end
        elif end > last:
            last = at = end
    return "".join([*out, text[at:]])
