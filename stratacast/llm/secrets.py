"""Secret scans: credentials by pattern, and weak ones by the parts that stand near them.

Base patterns report what is a secret by its form alone: assignments to a password-like
name, access key identifiers, long hexadecimal runs. Weak candidates are not reported for
themselves: a random-looking token could be anything, a login name or an address is no
secret. They are reported when complementary parts of one credential occur in one scope: an
identifier with a secret, or a secret with an endpoint, within REACH characters. A token
has 20 characters at least, and no upper bound. Parts are
joined by interval: each part stands in the stretches of REACH characters that its reach
touches, so that a join on (text, stretch) meets all pairs and few others.

All positions are code points; an end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacast.llm.common import Scratch

REACH = 200
#: Base kinds in their order of listing.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs: a run starts at its first character
BASE = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX))
#: Weak kinds: pattern, and the part they play.
WEAK = (
    ("login", r"(?i:\b(?:user(?:name)?|login|account|client_?id)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@=-]{3,}", "id"),
    ("random", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])"
               r"[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])", "secret"),
    ("endpoint", r"\b(?:https?|ftp|ssh|jdbc:[a-z]+|mysql|postgres(?:ql)?|mongodb|redis|amqp)://[^\s\"'<>]+", "endpoint"),
)
#: Base kinds also are parts: an access identifier needs its secret, and so on.
PARTS = {"assign": "secret", "access": "id", "hex": "secret"}
#: Which part completes which.
COMPLETES = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
KINDS = [kind for kind, _ in BASE] + [kind for kind, *_ in WEAK]
MASK = "<secret>"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, stop, body) of the pattern's matches, leftmost and not overlapping.

    Java's regular expressions give the matches, and the stretches between them; lengths
    added up give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(bodies, gaps):
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,body:string>>").alias("spans"))

        def step(held, number):
            body = F.element_at(bodies, number)
            begin = held["at"] + F.length(F.element_at(gaps, number))
            end = begin + F.length(body)
            return F.struct(end.alias("at"), F.concat(held["spans"], F.array(
                F.struct(begin.alias("start"), end.alias("stop"), body.alias("body")))).alias("spans"))

        return F.aggregate(F.sequence(F.lit(1), F.size(bodies)), start, step, lambda held: held["spans"])

    none = F.array().cast("array<struct<start:int,stop:int,body:string>>")
    return _let(found, lambda bodies: F.when(F.size(bodies) == 0, none).otherwise(
        _let(between, lambda gaps: placed(bodies, gaps))))


def _typed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop")
    ))


def _base(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 6)
    access = F.filter(matches(text, ACCESS), lambda s: F.length(s["body"]) >= 20)
    return F.array_sort(F.concat(
        _typed(assign, "assign"), _typed(access, "access"), _typed(matches(text, HEX), "hex")
    ))


def _weak(text: Column) -> Column:
    return F.concat(*(_typed(matches(text, pattern), kind) for kind, pattern, _ in WEAK))


def _role(rank: Column) -> Column:
    roles = PARTS | {kind: role for kind, _, role in WEAK}
    return F.element_at(F.array(*(F.lit(roles[kind]) for kind in KINDS)), rank + 1)


def _linked(scanned: DataFrame) -> DataFrame:
    """(row, linked): the weak candidates that a complementary part stands near."""
    some = scanned.filter("size(weak) > 0").select("row", "base", "weak")
    weak = some.select("row", "base", F.inline("weak")).filter(
        ~F.exists("base", lambda b: (b["start"] < F.col("stop")) & (F.col("start") < b["stop"]))
    ).drop("base")
    parts = some.select("row", F.inline(F.concat("base", "weak")))
    asks = weak.select(
        "row", F.col("start").alias("w_start"), F.col("stop").alias("w_stop"), F.col("rank").alias("w_rank"),
        _role(F.col("rank")).alias("w_role"),
        F.explode(F.expr(f"sequence(cast(greatest(start - {REACH}, 0) div {REACH} AS int), cast((stop + {REACH}) div {REACH} AS int))")).alias("stretch"),
    )
    gives = parts.select(
        "row", "start", "stop", _role(F.col("rank")).alias("role"),
        F.explode(F.expr(f"sequence(cast(start div {REACH} AS int), cast(stop div {REACH} AS int))")).alias("stretch"),
    )
    completes = F.lit(False)
    for role, others in COMPLETES.items():
        completes = completes | ((F.col("w_role") == role) & F.col("role").isin(*others))
    near = (F.col("start") <= F.col("w_stop") + REACH) & (F.col("stop") >= F.col("w_start") - REACH)
    apart = (F.col("stop") <= F.col("w_start")) | (F.col("start") >= F.col("w_stop"))
    met = asks.withColumnRenamed("row", "w_row").join(
        gives, (F.col("w_row") == F.col("row")) & (asks["stretch"] == gives["stretch"]) & completes & near & apart, "left_semi"
    )
    return met.groupBy(F.col("w_row").alias("row")).agg(F.collect_set(F.struct(
        F.col("w_start").alias("start"), F.col("w_rank").alias("rank"), F.col("w_stop").alias("stop")
    )).alias("linked"))


def _scanned(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`docs` with base and linked spans, arrays of (start, rank of the kind, stop)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = scratch.save(docs.select(
        F.struct(*docs.columns).alias("kept"), F.monotonically_increasing_id().alias("row"),
        _base(text).alias("base"), _weak(text).alias("weak"),
    ), "scanned")
    return stored.join(_linked(stored), "row", "left").select(
        "kept", "base", F.coalesce("linked", F.expr("slice(base, 1, 0)")).alias("linked")
    )


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(kind) for kind in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")
    )), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one per row of `docs`.

    `spans` lists kind:start:end of base spans and of linked weak candidates, by start, then
    by kind; base_sha256 is the SHA-256 of such a list of the base spans alone. Null texts
    count as empty. Rows without doc_id and rows that repeat are scanned like any other.
    Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    stored = scratch.save(docs.select(
        "doc_id", F.monotonically_increasing_id().alias("row"), _base(text).alias("base"), _weak(text).alias("weak"),
    ), "scanned")
    both = stored.join(_linked(stored), "row", "left")
    all_spans = F.array_sort(F.concat("base", F.coalesce("linked", F.expr("slice(base, 1, 0)"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return both.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(all_spans).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every reported span of `text` replaced by a mark; n_chars follows if there is one.

    Spans that overlap are replaced as one. Null texts stay null.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    found = _scanned(docs, scratch)
    text = F.col("kept.text")

    def cut(body, spans):
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

        def step(held, span):
            gap = F.substring(body, held["at"] + 1, F.greatest(span["start"] - held["at"], F.lit(0)))
            return F.struct(
                F.greatest(held["at"], span["stop"]).alias("at"),
                F.concat(held["done"], gap, F.when((held["at"] > span["start"]) & (held["at"] > 0), F.lit("")).otherwise(F.lit(MASK))).alias("done"),
            )

        return F.aggregate(spans, start, step, lambda held: F.concat(held["done"], F.substring(body, held["at"] + 1, F.length(body))))

    clean = F.when(F.size(F.col("base")) + F.size(F.col("linked")) == 0, text).otherwise(
        _let(text, lambda body: _let(F.array_sort(F.concat("base", "linked")), lambda spans: cut(body, spans)))
    )
    out = found.withColumn("clean", clean)
    replaced = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*(replaced.get(c, F.col("kept")[c]).alias(c) for c in docs.columns))
