"""Secret scans by corpus-wide ownership frequency.

Every text is searched for credential patterns. The three base kinds always count. The further kinds
(key blocks, signed tokens, prefixed keys, opaque strings) are only candidates: their values are
hashed, the hashes are counted over distinct repositories and owners of the whole corpus, and a value
that many owners share is a copied example, while one that stays with few owners and looks random is
live, in however many documents of theirs it stands. How many owners are many grows with the owners of the
corpus. Only live candidates become spans. Repositories are distinct texts where no column names them.

Nulls: a null text has no spans; a null owner or repository counts as one owner or repository of its
own. Very long texts are searched whole; matches of one kind do not overlap, the leftmost stands. Empty tables give empty results. Repeated rows are scanned row by row.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage

from .common import pylist, register, schema_of, slices, table, tidy

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

BASE = ("assign", "access", "hex")
MORE = {
    "block": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]{16,}-----END [A-Z ]*PRIVATE KEY-----"),
    "signed": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "prefixed": re.compile(r"\b(?:gh[opsu]_|glpat-|xox[abprs]-|sk[-_]|rk_|pk_)[A-Za-z0-9_-]{16,}"),
}
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
KINDS = (*BASE, *MORE, "opaque")

SPAN = "struct<start:int, ord:int, end:int, digest:string, entropy:double>"


def entropy(value: str) -> float:
    """Bits a character, by the value's own character counts."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def _opaque(value: str) -> bool:
    kinds = (any(map(str.isdigit, value)), any(map(str.islower, value)), any(map(str.isupper, value)))
    return all(kinds) and entropy(value) >= 3.5


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of every match of one text, by start and kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= ACCESS_LEAST:
                found.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        found.append((m.start(), 2, m.end(), m[0]))
    for k, (kind, pattern) in enumerate(MORE.items(), len(BASE)):
        if kind == "block" and "-----BEGIN" not in text or kind == "signed" and "eyJ" not in text:
            continue
        found += [(m.start(), k, m.end(), m[0]) for m in pattern.finditer(text)]
    for m in OPAQUE.finditer(text):
        if _opaque(m[0]):
            found.append((m.start(), len(KINDS) - 1, m.end(), m[0]))
    return sorted(found)


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = None) -> DataFrame:
    """Rows of (row, rec, owner, repository, spans): every record with what the patterns match in it."""
    held_in = F.xxhash64(F.col(text).cast("string")) if repository is None else F.col(repository)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.struct("*").alias("rec"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(held_in.cast("string"), F.lit("")).alias("repository"),
        F.col(text).cast("string").alias("text"),
    )
    schema = schema_of(rows.drop("text").schema, f"spans array<{SPAN}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([
            ("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32()), ("digest", pa.string()), ("entropy", pa.float64())
        ]))
        for batch in slices(batches):
            spans = [
                [
                    {"start": s, "ord": k, "end": e, "digest": hashlib.sha256(v.encode()).hexdigest()[:32], "entropy": entropy(v)}
                    for s, k, e, v in find(t)
                ] if t else []
                for t in pylist(batch, "text")
            ]
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(spans, kind)], schema=kept.schema.append(pa.field("spans", kind))
            )

    return rows.mapInArrow(tidy(run), schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """(digest, owners, repositories): how many distinct owners and repositories hold each value."""
    held = scanned.select(F.explode("spans.digest").alias("digest"), "owner", "repository").distinct()
    by_owner = held.groupBy("digest", "owner").agg(F.count(F.lit(1)).alias("n"))
    repositories = held.select("digest", "repository").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("digest").agg(F.count(F.lit(1)).alias("owners")).join(repositories, "digest")


def find_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str | None = None, keep: list[str] | None = None,
    live_owners: int = 2, live_share: float = 0.001, live_entropy: float = 3.0,
) -> DataFrame:
    """(rec, spans): each record and its spans, sorted; a span has kind, start, end, owners, repositories, live.

    ``live`` holds where at most ``live_owners`` owners, or ``live_share`` of all owners if that is more, have the
    value and its entropy reaches ``live_entropy``. Base spans are returned whatever they are, the others
    only if live. ``keep`` names the record's columns to carry, all by default.
    """
    scanned = scan(docs, text, owner, repository)
    if keep is not None:
        scanned = scanned.withColumn("rec", F.struct(*[F.col(f"rec.`{c}`") for c in keep]))
    scanned = stage(scanned, "secret-scan")
    one = scanned.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    judged = one.join(ownership(scanned), "digest")
    all_owners = scanned.select("owner").distinct().count()
    live = (F.col("owners") <= max(live_owners, int(live_share * all_owners))) & (F.col("entropy") >= live_entropy)
    judged = judged.withColumn("live", live).where(F.col("live") | (F.col("ord") < len(BASE)))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("ord") + 1).alias("kind")
    kept = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "ord", "end", name, "owners", "repositories", "live"))).alias("found")
    )
    none = scanned.where(F.size("spans") == 0).select("rec", F.array().cast(kept.schema["found"].dataType).alias("spans"))
    some = scanned.where(F.size("spans") > 0).select("row", "rec").join(kept, "row", "left")
    empty = F.array().cast(kept.schema["found"].dataType)
    return none.unionAll(some.select("rec", F.coalesce("found", empty).alias("spans")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by one mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        piece = F.when(
            fresh, F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mark))
        ).otherwise(done["out"])
        return F.struct(piece.alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    return F.aggregate(
        spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )


@register("op9_secret_scan")
def op9(spark, sf_dir):
    """Every secret of every document, base kinds and live further ones."""
    found = find_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["ord"] == k)).cast("long")
    return found.select(
        F.col("rec.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )
