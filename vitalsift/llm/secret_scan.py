"""Secrets in texts, with column expressions only: base patterns, and weak parts that occur together.

Base kinds, leftmost and without overlap within a kind; matches that are too short are dropped:

- ``assign``: a word such as ``password``, a colon or equals sign, and a value of 6 characters
- ``access``: ``AKIA`` with capitals and digits, 20 characters together
- ``hex``: 24 hexadecimal digits in lower case

A user name, a random-looking token or an endpoint alone means nothing. These weak parts are
reported when complementary parts stand in the same scope, the text between two blank lines:
``linked_secret`` beside an identifier or endpoint, ``linked_id`` beside a secret,
``linked_endpoint`` beside both. Base matches count as identifiers and secrets here.

A pattern yields texts, not places, so each match is taken together with the gap before it, and
places are running sums of lengths. Parts and scopes, as intervals of one text, are joined by
merging: in the order of their places, the blank lines passed so far number the scope that a part
lies in. Each scope gathers the roles of its parts, and a part looks at these. The work grows with
the number of parts, not with that of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalsift.llm.common import Workspace

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "linked_id", "linked_secret", "linked_endpoint")

# The patterns of the base kinds. Group 2 is the match.
WORDS = "(?i:password|passwd|secret|token|api_?key)"
GAP = r"\G([\s\S]*?)"
ASSIGN = GAP + r"(" + WORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = GAP + r"(AKIA[A-Z0-9]{16,}+)"
HEX = GAP + r"((?<![0-9a-f])[0-9a-f]{24,}+)"
# Weak parts.
ID_WORDS = "(?i:client_?id|access_?key(?:_?id)?|user(?:_?name)?|login)"
# A secret access key is no identifier, the access key's id is one.
IDENTIFIER = (
    GAP + r"((?<![A-Za-z0-9])(?<!(?i:secret)_)" + ID_WORDS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+)"""
)
# Starts at the run's begin or after an equals sign, where the looks ahead end too: linear in the run's length.
TOKEN = (
    GAP + r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])"
    r"[A-Za-z0-9+/_=-]{20,}+)"
)
ENDPOINT = GAP + r"(\b(?i:https?|postgres|mysql|amqp|redis)://[A-Za-z0-9.-]++(?::[0-9]{1,5})?)"
# A line of blanks only, with either kind of line end.
BREAK = GAP + r"(\n[ \t\r]*+\n)"

NO_ID = "none"
PART = "array<struct<kind:string,place:int,gap:int,size:int>>"


def _parts(text: Column, kind: str, pattern: str, hint: Column, value_least: int = 0) -> Column:
    """Matches of a pattern in order: place in that order, length of the gap before, length.

    Matches whose group 3 is shorter than ``value_least`` keep their place under no kind.
    """
    def groups(k: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    values = groups(3) if value_least else groups(2)
    zipped = F.arrays_zip(groups(1).alias("gap"), groups(2).alias("found"), values.alias("value"))
    found = F.transform(zipped, lambda x, k: F.struct(
        F.when(F.length(x["value"]) >= value_least, kind).alias("kind"),
        k.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"),
    ))
    return F.when(hint, found.cast(PART)).otherwise(F.array().cast(PART))


def extract(documents: DataFrame) -> DataFrame:
    """The document's id as text, the text's digest, and the parts found by each pattern, in one pass.

    Ids are joined on later, so a missing one is the text ``NO_ID``, which no number is.
    """
    # Patterns that can only match after a hint are tried on few texts.
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    text = F.col("text")
    access = text.rlike("AKIA[A-Z0-9]{16}")
    rows = rows.withColumns({
        "has_assign": text.rlike(WORDS), "has_access": access, "has_hex": text.rlike("[0-9a-f]{24}"),
        "has_weak": access | text.rlike(ID_WORDS + "|://"),
    })
    weak = F.col("has_weak")
    return rows.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID)).alias("id"),
        F.md5(F.encode("text", "utf-8")).alias("digest"),
        _parts(text, "assign", ASSIGN, F.col("has_assign"), 6).alias("assign"),
        _parts(text, "access", ACCESS, F.col("has_access")).alias("access"),
        _parts(text, "hex", HEX, F.col("has_hex")).alias("hex"),
        _parts(text, "linked_id", IDENTIFIER, weak).alias("linked_id"),
        _parts(text, "linked_secret", TOKEN, weak).alias("linked_secret"),
        _parts(text, "linked_endpoint", ENDPOINT, weak).alias("linked_endpoint"),
        _parts(text, "break", BREAK, weak).alias("break"),
    )


KEY = ["id", "digest"]


def place_parts(extracted: DataFrame) -> DataFrame:
    """One row per part: key, kind, start, end; equal rows of the input count once."""
    streams = F.array(*[F.struct(F.lit(k).alias("stream"), F.col(k).alias("parts")) for k in (*KINDS, "break")])
    rows = (
        extracted.select(*KEY, F.inline(streams))
        .select(*KEY, "stream", F.inline("parts"))
        .groupBy(*KEY, "stream", "place").agg(*[F.first(c).alias(c) for c in ("kind", "gap", "size")])
    )
    through = Window.partitionBy(*KEY, "stream").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(through).cast("int"))
        .filter("kind is not null")
        .select(*KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def link(parts: DataFrame) -> DataFrame:
    """The weak parts that have complementary parts in their scope."""
    roles = {
        "id": F.col("kind").isin("access", "linked_id"),
        "secret": F.col("kind").isin("assign", "hex", "linked_secret"),
        "endpoint": F.col("kind") == "linked_endpoint",
    }
    # Breaks before a part number its scope.
    before = (
        Window.partitionBy(*KEY).orderBy("start", (F.col("kind") != "break"), "kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    scope = Window.partitionBy(*KEY, "scope")
    scoped = parts.withColumn("scope", F.sum((F.col("kind") == "break").cast("int")).over(before)).withColumns(
        {f"has_{role}": F.max(own).over(scope) for role, own in roles.items()}
    )
    return scoped.filter(
        ((F.col("kind") == "linked_secret") & (F.col("has_id") | F.col("has_endpoint")))
        | ((F.col("kind") == "linked_id") & F.col("has_secret"))
        | ((F.col("kind") == "linked_endpoint") & F.col("has_secret") & F.col("has_id"))
    ).select(*KEY, "kind", "start", "end")


def find_secrets(work: Workspace, documents: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (MD5 of the text), ``copies`` and ``spans`` per distinct (doc_id, text).

    ``spans`` are (kind, start, end) in code points, by start and then by kind as listed in
    ``KINDS``. ``copies`` counts rows with equal id and text; a null text counts as empty and
    has no spans. Rows without an id are scanned and linked like all others. Other columns are ignored;
    an empty table gives no rows. Only matches are shuffled, never texts.
    """
    extracted = work.store("extracted", extract(documents))
    parts = work.store("parts", place_parts(extracted))
    # Documents with a weak part of any kind; no other can have a link.
    weak = parts.filter(F.col("kind").startswith("linked")).select(*KEY).distinct()
    linked = link(parts.join(weak, KEY, "left_semi"))
    spans = parts.filter(F.col("kind").isin(*BASE_KINDS)).unionByName(linked)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    lists = spans.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("found")
    )
    span = "array<struct<kind:string,start:int,end:int>>"
    rows = extracted.groupBy(*KEY).agg(F.count("*").alias("copies"))
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).cast("long")
    return rows.join(lists, KEY, "left").select(
        doc_id.alias("doc_id"), "digest", "copies",
        F.coalesce(
            F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
            F.array().cast(span),
        ).alias("spans"),
    )


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def digest_columns(found: DataFrame) -> DataFrame:
    """A row per document: counts and a digest of the base kinds, and all spans as text."""
    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    columns = found.select(
        "doc_id", *[of(k) for k in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return columns.drop("copy")


def redact(work: Workspace, documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret's span replaced by ``mark``; ``n_chars`` follows the text.

    Rows without secrets stay as they are, a null text included, and rows without an id are
    redacted too. Overlapping spans become one mark. An empty table gives no rows.
    """
    found = (
        find_secrets(work, documents).filter(F.size("spans") > 0)
        .select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "spans")
    )
    found = work.store("found", found)
    own = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    joined = documents.withColumn("_own", own).join(
        found.withColumnRenamed("spans", "_spans"),
        F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest")), "left",
    )
    # Walk over the spans, keeping the text so far and the place up to which it is done.
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("done"))

    def step(state: Column, s: Column) -> Column:
        gap = F.col("text").substr(state["done"] + 1, F.greatest(s["start"] - state["done"], F.lit(0)))
        sign = F.when(s["start"] >= state["done"], F.lit(mark)).otherwise("")
        return F.struct(
            F.concat(state["text"], gap, sign).alias("text"), F.greatest(state["done"], s["end"]).alias("done")
        )

    walked = F.aggregate("_spans", start, step)
    clean = F.when(
        F.col("_spans").isNotNull(),
        F.concat(walked["text"], F.col("text").substr(walked["done"] + 1, F.length("text"))),
    ).otherwise(F.col("text"))
    result = joined.withColumn("_clean", clean)
    columns = {"text": F.col("_clean")}
    if "n_chars" in documents.columns:
        kept = F.col("n_chars")
        columns["n_chars"] = F.when(F.col("_spans").isNotNull(), F.length("_clean").cast(documents.schema["n_chars"].dataType)).otherwise(kept)
    return result.select(*[columns.get(c, F.col(c)).alias(c) for c in documents.columns])
