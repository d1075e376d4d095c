"""Payloads read without the rules and their decoders, and how many of them findings tell.

Each kind has a reader of its own over the text: runs of tags and of selectors and the zero-width carriers are extracted
by one pattern each and turned into bytes by their code points in UTF-32. Zero-width binary is read here only: some texts
carry bits as a pair of zero-width characters; their counts order them, and each ordered pair of the four commonest is
tried. A row is audited where it stands, against its own findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgate.functions import properties as P
from glyphgate.functions import text as X
from glyphgate.functions.rows import computed

# Characters that carry bits.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
LEAST_BITS, COMMONEST = 64, 4


def _zero_width(text: Column) -> tuple[dict[str, Column], Column]:
    """The columns to compute first, and the payload that they lead to."""
    wanted = f"[{P.char_class((), tuple(map(ord, ZERO_WIDTH)))}]"
    enough = F.regexp_count(text, F.lit(wanted)) >= LEAST_BITS
    carriers = F.when(enough, F.array_join(F.regexp_extract_all(text, F.lit(wanted), F.lit(0)), ""))
    count = lambda c: F.length("__carriers") - F.length(F.replace("__carriers", F.lit(c), F.lit("")))
    counts = F.array(*[F.struct((-count(c)).alias("n"), F.lit(c).alias("c")) for c in ZERO_WIDTH])
    best = F.transform(F.slice(F.array_sort(F.filter("__counts", lambda x: x["n"] < 0)), 1, COMMONEST), lambda x: x["c"])
    pairs = F.flatten(F.transform("__best", lambda zero: F.transform(F.filter("__best", lambda one: one != zero), lambda one: F.struct(zero.alias("zero"), one.alias("one")))))

    def spelled(pair: Column) -> Column:
        bits = F.replace(F.replace("__carriers", pair["zero"], F.lit("0")), pair["one"], F.lit("1"))
        return _bits(F.regexp_replace(bits, "[^01]", ""))

    readable = lambda t: ~t.rlike(r"[^\t\n\r\P{C}]|[^\t\n\r\x20\P{Z}]") & (F.size(F.array_distinct(F.split(t, ""))) > 1) & (t != "")
    payload = F.get(F.filter(F.transform(pairs, spelled), lambda t: t.isNotNull() & readable(t)), F.lit(0))
    return {"__carriers": carriers, "__counts": counts, "__best": best}, payload


def _bits(digits: Column) -> Column:
    octets = F.regexp_extract_all(digits, F.lit("[01]{8}"), F.lit(0))
    return X.strict_utf8(F.array_join(F.transform(octets, lambda o: F.lpad(F.conv(o, 2, 16), 2, "0")), ""))


def _selector_hex(run: Column) -> Column:
    """The bytes of selectors as hexadecimal digits, from their UTF-32 digits: 0000FEnn is n, 000E01nn is nn and sixteen."""
    wide = F.regexp_extract_all(F.hex(F.encode(run, "UTF-32")), F.lit("[0-9A-F]{8}"), F.lit(0))
    value = lambda w: F.when(w < "000E0100", F.conv(F.right(w, F.lit(1)), 16, 10).cast("int")).otherwise(F.conv(F.right(w, F.lit(2)), 16, 10).cast("int") + 16)
    return F.array_join(F.transform(wide, lambda w: F.lpad(F.hex(value(w)), 2, "0")), "")


def with_payloads(df: DataFrame) -> DataFrame:
    """``df`` with ``payloads``: (kind, payload) of the tags, selector bytes, selector bits and zero-width binary of its text."""
    tag, pair = "[\\x{E0020}-\\x{E007E}]", "\\x{FE0E}\\x{FE0F}"
    one = "[" + P.char_class(P.SELECTORS) + "]"
    text = F.coalesce(F.col("text"), F.lit(""))
    found = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # Tags after a flag that name a region are the flag's own.
    flags = "|".join("".join(f"\\x{{{0xE0000 + ord(c):X}}}" for c in name) + f"\\x{{{P.CANCEL_TAG:X}}}" for name in P.FLAG_SEQUENCES)
    bare = F.regexp_replace(text, f"(\\x{{{P.FLAG_BASE:X}}})(?:{flags})", "$1")
    runs = F.regexp_extract_all(bare, F.lit(f"{tag}+"), F.lit(0))
    letters = "".join(map(chr, range(0x20, 0x7F)))
    tags = F.transform(runs, lambda r: F.translate(r, "".join(chr(0xE0000 + ord(c)) for c in letters), letters))
    spelled = F.filter(F.transform(found(f"{one}{{2,}}"), lambda r: X.printable(X.strict_utf8(_selector_hex(r)))), lambda t: t.isNotNull())
    # Bits: single emoji selectors after characters that are no emoji.
    single = found(f"[^{P.char_class(P.EMOJI + P.SELECTORS)}]([{pair}])(?!{one})", 1)
    steps, payload = _zero_width(text)
    kept = df.columns
    for name, column in (steps | {"__single": F.array_join(single, "")}).items():
        df = computed(df, {name: column})
    swapped = lambda zero, onec: F.translate("__single", zero + onec, "01")
    some = F.length("__single") >= LEAST_BITS
    bits = F.when(some, F.coalesce(X.clean(_bits(swapped("\ufe0e", "\ufe0f"))), X.clean(_bits(swapped("\ufe0f", "\ufe0e")))))
    named = lambda kind, payloads: F.transform(payloads, lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("payload")))
    single_of = lambda p: F.when(p.isNotNull(), F.array(p)).otherwise(F.array().cast("array<string>"))
    both = F.concat(named("tag-characters", tags), named("selector-bytes", spelled), named("selector-bits", single_of(bits)), named("zero-width-binary", single_of(payload)))
    return df.withColumn("payloads", both).select(*kept, "payloads")


def zero_width_payloads(docs: DataFrame) -> DataFrame:
    """(doc_id, payload) of texts that hide binary in zero-width characters: the first pair of carriers that spells a text.

    Pairs are tried by how common their first and then their second carrier is, equally common ones by code point. A
    text counts if it is printable but for tab and line breaks and has more than one distinct character.
    """
    found = with_payloads(docs.select("doc_id", "text"))
    return found.select("doc_id", F.inline("payloads")).where("kind = 'zero-width-binary'").select("doc_id", "payload")


def payload_audit(rows: DataFrame) -> DataFrame:
    """Per kind: payloads of documents with ``findings``, and those that a finding of their row spells out."""
    told = F.filter(F.transform("findings", lambda f: f["decoded"]), lambda d: d.isNotNull())
    hit = lambda p: F.exists(told, lambda t: F.contains(t, p["payload"]))
    judged = with_payloads(rows).select(F.explode(F.transform("payloads", lambda p: F.struct(p["kind"].alias("kind"), hit(p).alias("hit")))).alias("x"))
    return judged.groupBy("x.kind").agg(F.count("*").alias("payloads"), F.count_if("x.hit").alias("reported"))
