"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every text is a blob, addressed by its SHA-256. A ledger is a Parquet table of (blob, rule_version, spans): each blob
that a rule version has seen, with what it found. A scan takes the distinct blobs of the input (copies are dropped
before the shuffle), leaves out those whose pair of blob and rule version the ledger has, scans the rest, appends them
to the ledger, and joins the ledger's findings back to every row. A later scan of the same history with the same rules
reads no text twice; changed rules get another version and so scan again. Unseen blobs are found by address, and only
their bodies are moved. ``scan_versions`` does this for all versions of a set of paths.

Positions come from ``split`` and ``regexp_extract_all`` with one pattern: the pieces between matches and the matches
alternate, so a match starts where the lengths before it end. Both walk leftmost and non-overlapping.

Kinds: assign, access and hex as fixed below, then two of this method's own, ``pem`` (private-key headers) and
``vcs`` (access tokens with a fixed prefix). Of the assign matches those with a value under 8 characters are dropped.
Access and hex patterns carry their least length in the pattern, which for maximal runs is the same as dropping.

Defined results. Null text: as an empty text. Null doc_id and repeated rows: each row gets its blob's findings. Ties
of start: by the order of the kinds. Empty table: no rows, an empty ledger. Other columns are ignored by ``scan`` and
kept by ``redact``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import rows
from glyphgate.llm.common import materialize, new_path

# The base kinds, with letters in either case spelled out so that only ASCII letters match.
_NAMES = ("password", "passwd", "secret", "token")
_WORD = "|".join(["".join(f"[{c.upper()}{c}]" for c in name) for name in _NAMES] + ["[Aa][Pp][Ii]_?[Kk][Ee][Yy]"])
_LEAD = rf"(?:{_WORD})[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = rf"{_LEAD}[A-Za-z0-9+/_.=-]+"
VALUE = rf"^{_LEAD}([A-Za-z0-9+/_.=-]+)$"
LEAST_VALUE = 8
#: Matches that are summed up together, and characters of a stretch of text.
PIECE, STRETCH = 128, 1024
#: Unseen addresses that are broadcast at most, about 100 bytes each.
FEW = 200_000
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# This method's own kinds.
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
VCS = r"gh[pousr]_[A-Za-z0-9]{36,}"

#: Kind and pattern, in the order of the kinds.
RULES = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("pem", PEM), ("vcs", VCS))
BASE = ("assign", "access", "hex")
RULE_VERSION = hashlib.sha256(repr((RULES, LEAST_VALUE)).encode()).hexdigest()[:16]

SPANS = "array<struct<start:long,no:int,kind:string,end:long>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


def _before(values: str, join, name: str) -> dict[str, dict[str, Column]]:
    """Steps that compute ``name``: for each element of the array ``values`` what ``join`` makes of 0 and all earlier ones.

    The array is cut into pieces of ``PIECE``: totals of the pieces are folded one by one, and within a piece each element
    looks at the earlier ones of its piece, so the work grows with the elements and not with their square.
    """
    zero, long = F.lit(0).cast("long"), F.col(values)
    pieces = F.transform(F.filter(F.sequence(F.lit(0), F.ceil(F.size(long) / PIECE).cast("int")), lambda k: k * PIECE < F.size(long)), lambda k: F.slice(long, k * PIECE + 1, F.lit(PIECE)))
    totals = F.transform(f"{name}_p", lambda p: F.aggregate(p, zero, join))
    heads = F.aggregate(totals, F.array(zero), lambda found, t: F.concat(found, F.array(join(F.element_at(found, -1), t))))
    both = F.arrays_zip(F.col(f"{name}_p").alias("p"), F.slice(f"{name}_h", F.lit(1), F.size(f"{name}_p")).alias("head"))
    each = F.transform(both, lambda x: F.transform(x["p"], lambda v, i: F.aggregate(F.slice(x["p"], F.lit(1), i), x["head"], join)))
    return {"pieces": {f"{name}_p": pieces}, "heads": {f"{name}_h": heads}, "each": {name: F.flatten(each)}}


def _computed(df: DataFrame, steps: list[dict[str, dict[str, Column]]]) -> DataFrame:
    """The steps of several ``_before``, side by side."""
    for stage in ("pieces", "heads", "each"):
        df = rows.computed(df, {name: column for s in steps for name, column in s[stage].items()})
    return df


def with_found(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``spans``: all spans of the column ``text`` by start, then kind; end is exclusive, in code points."""
    kept, body = df.columns, F.col(text)
    nothing = F.array().cast("array<string>")
    cut = {}
    for kind, pattern in RULES:
        some = F.rlike(body, F.lit(pattern))
        cut[f"__{kind}_gaps"] = F.when(some, F.split(body, pattern, -1)).otherwise(nothing)
        cut[f"__{kind}_hits"] = F.when(some, F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(nothing)
    df = rows.computed(df, cut)
    long = lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long")
    sizes = {f"__{kind}_sizes": F.transform(F.arrays_zip(F.col(f"__{kind}_gaps").alias("gap"), F.col(f"__{kind}_hits").alias("hit")), long) for kind, _ in RULES}
    df = _computed(rows.computed(df, sizes), [_before(f"__{kind}_sizes", lambda a, b: a + b, f"__{kind}_at") for kind, _ in RULES])

    def spans(no: int, kind: str) -> Column:
        n = F.size(f"__{kind}_hits")
        each = F.arrays_zip(F.col(f"__{kind}_hits").alias("hit"), F.slice(f"__{kind}_gaps", F.lit(1), n).alias("gap"), F.slice(f"__{kind}_at", F.lit(1), n).alias("at"))
        if kind == "assign":
            each = F.filter(each, lambda x: F.length(F.regexp_extract(x["hit"], VALUE, 1)) >= LEAST_VALUE)
        begin = lambda x: x["at"] + F.length(x["gap"])
        return F.transform(each, lambda x: F.struct(begin(x).alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (begin(x) + F.length(x["hit"])).alias("end")))

    found = F.array_sort(F.concat(*[spans(no, kind) for no, (kind, _) in enumerate(RULES)])).cast(SPANS)
    return rows.computed(df, {"spans": found}).select(*kept, "spans")


def _addressed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.sha2(text, 256).alias("blob"), text.alias("body"))


def update_ledger(docs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scan the blobs of ``docs`` that ``ledger`` has not for this rule version; return the ledger."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)  # so that a new ledger can be read
    seen = spark.read.schema(LEDGER).parquet(ledger)
    known = seen.where(F.col("rule_version") == rule_version).select("blob")
    fresh = _addressed(docs)
    if not known.isEmpty():
        # Addresses alone are compared; a bounded number of unseen ones is sent to the texts, more meet them in a shuffle.
        unseen = materialize(fresh.select("blob").distinct().join(known, "blob", "left_anti"), "unseen")
        few = unseen.limit(FEW + 1).count() <= FEW
        fresh = fresh.join(F.broadcast(unseen) if few else unseen, "blob", "left_semi")
    # Copies go before the shuffle: the first text of each blob is combined within each task.
    fresh = fresh.groupBy("blob").agg(F.first("body").alias("body"))
    scanned = with_found(fresh, "body").select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    scanned.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def with_spans(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """All columns of ``docs`` with ``__blob`` and ``__spans``; the latter is empty where nothing was found."""
    ledger = ledger or new_path(docs.sparkSession, "ledger")
    found = update_ledger(docs, ledger, rule_version)
    hits = found.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select(F.col("blob").alias("__hit"), F.col("spans").alias("__spans"))
    # Two scans that overlap in time may both add a blob; the join below needs this partitioning anyhow.
    hits = hits.dropDuplicates(["__hit"])
    named = docs.withColumn("__blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    joined = named.join(hits, F.col("__blob") == F.col("__hit"), "left").drop("__hit")
    return joined.withColumn("__spans", F.coalesce(F.col("__spans"), F.array().cast(SPANS)))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """doc_id, counts by base kind, base_sha256 and spans of each row."""
    found = with_spans(docs.select("doc_id", "text"), ledger)
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("__spans", lambda s: s["no"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("__spans")).alias("spans"),
    )


def scan_versions(files: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, version, kind, start and end of every finding of ``files`` (path, version, text): each blob is scanned once,
    whatever paths and versions have it, and its findings come back with all of them."""
    found = with_spans(files.select("path", "version", "text"), ledger, rule_version)
    return found.select("path", "version", F.explode("__spans").alias("s")).select("path", "version", "s.kind", "s.start", "s.end")


def redact(docs: DataFrame, ledger: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced; spans that overlap give one mark. ``n_chars``, if there, is brought up to date."""
    found = rows.computed(with_spans(docs, ledger), {"__ends": F.transform("__spans", lambda s: s["end"])})
    found = _computed(found, [_before("__ends", lambda a, b: F.greatest(a, b), "__reach")])
    text = F.coalesce(F.col("text"), F.lit(""))
    # A span that begins before an earlier one has ended is part of its mark.
    apart = F.filter(F.arrays_zip(F.col("__spans").alias("s"), F.col("__reach").alias("reach")), lambda x: x["s"]["start"] >= x["reach"])
    found = rows.computed(found, {"__blocks": F.when(F.size("__spans") > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)))})

    def between(a: Column, b: Column) -> Column:
        """Characters a to b of the text, from its stretches: no more is walked over than is copied."""
        low = lambda k: F.greatest(a - k * STRETCH, F.lit(0))
        one = lambda k: F.substr(F.get("__blocks", k.cast("int")), (low(k) + 1).cast("int"), (F.least(b - k * STRETCH, F.lit(STRETCH)) - low(k)).cast("int"))
        return F.when(b > a, F.array_join(F.transform(F.sequence(F.floor(a / STRETCH), F.floor((b - 1) / STRETCH)), one), "")).otherwise("")

    pieces = F.concat(F.transform(apart, lambda x: between(x["reach"], x["s"]["start"])), F.array(between(F.array_max("__ends"), F.length(text).cast("long"))))
    new = found.withColumn("__text", F.when(F.size("__spans") > 0, F.array_join(pieces, mark)).otherwise(F.col("text")))
    columns = [F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return new.select(*columns)
