"""Secret scans that link the parts of a credential.

Three kinds of span stand by themselves: assignments of a secret, access
identifiers and long hexadecimal runs. Three weaker kinds count only beside
their complements: a mixed token needs an identifier within reach, a login
needs a secret and an endpoint, an endpoint needs an identifier and a secret.
Reach is a number of code points before and after the candidate; candidates
and parts of a document are joined as intervals, both cut into steps of the
reach so that the join is an equality on document and step.

Matches and their places come from built-in functions: what lies between the
matches of a pattern, and the matches, add up to the places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import cut, row_keys, text_or_empty

REACH = 400
#: Base kinds in the order in which spans that start together are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "login", "endpoint")

# Patterns of the base kinds (fixed values).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGNED, ACCESS_LEN, HEX_LEN = 12, 18, 16

# Patterns of the weaker kinds.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}"
LOGIN = r"""(?i)(?:user_?name|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"(?i)(?:https?|ftp|sftp|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}"

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: str, keep=None, may: Column | None = None) -> Column:
    """Matches of a pattern as spans, leftmost and not overlapping; keep(hits, tails) tells which stay."""
    p = F.lit(pattern)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    flags = keep(text, p, hits) if keep else F.transform(hits, lambda h: F.lit(True))
    steps = F.arrays_zip(F.transform(F.split(text, pattern), lambda g: F.length(g)).alias("gap"), F.transform(hits, lambda h: F.length(h)).alias("hit"), flags.alias("ok"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.coalesce(s["hit"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["ok"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    found = F.aggregate(steps, zero, add, lambda a: a["found"])
    hit = text.rlike(pattern) if may is None else may & text.rlike(pattern)
    return F.when(hit, found).otherwise(F.array().cast(SPAN))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _long(size: int, group: int = 0):
    return lambda text, p, hits: F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda h: F.length(h) >= size)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind. A cheaper test of the whole text comes first."""
    low = F.lower(text)
    return {
        "assign": _spans(text, ASSIGN, "assign", _long(ASSIGNED, 2), _any(low, ["password", "passwd", "secret", "token", "key"])),
        "access": _spans(text, ACCESS, "access", _long(ACCESS_LEN), text.contains("AKIA")),
        "hex": _spans(text, HEX, "hex", _long(HEX_LEN), text.rlike(f"[0-9a-f]{{{HEX_LEN}}}")),
    }


def weak_spans(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "token": _spans(text, TOKEN, "token"),
        "login": _spans(text, LOGIN, "login", may=_any(low, ["user", "login", "account", "client"])),
        "endpoint": _spans(text, ENDPOINT, "endpoint", may=text.contains("://")),
    }


def _some(name: str) -> Column:
    return F.size(name) > 0


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(id, k1, k2, assign, access, hex, linked): spans of each row of docs.

    Spans are (start, kind, end) in code points, end exclusive, in order; linked
    holds the weaker ones that have their complements. A null text counts as
    empty and has no spans. Repeated rows each get their spans; a null id is
    kept. Columns of docs other than the id and the text are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text).alias("_text"))
    rows = rows.select("_id", "_text", *row_keys("_id", F.col("_text")))
    rows = rows.select("_id", "k1", "k2", "_text", *(c.alias(k) for k, c in base_spans(F.col("_text")).items()))
    # A weaker kind is looked for only where a text has what complements it.
    weak, none = weak_spans(F.col("_text")), F.array().cast(SPAN)
    secret, ident = _some("assign") | _some("hex"), _some("access")
    rows = rows.select("*", weak["login"].alias("login"), weak["endpoint"].alias("endpoint"))
    rows = rows.select("*", F.when(ident | _some("login"), weak["token"]).otherwise(none).alias("token"))
    light = cut(rows.drop("_text"))

    whole = light.where((_some("token") & (ident | _some("login"))) | ((secret | _some("token")) & _some("endpoint") & (ident | _some("login"))))
    parts = whole.select("k1", "k2", F.explode(F.concat(*KINDS)).alias("s")).distinct()
    parts = parts.select("k1", "k2", "s.start", "s.kind", "s.end")
    step = F.lit(reach)
    near = parts.select("k1", "k2", "kind", F.col("start").alias("s0"), F.col("end").alias("e0"), F.explode(F.sequence(F.floor(F.col("start") / step), F.floor(F.col("end") / step))).alias("step"))
    wide = parts.where(F.col("kind") >= len(BASE)).withColumn("step", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - step, F.lit(0)) / step), F.floor((F.col("end") + step) / step))))
    met = wide.join(near.withColumnRenamed("kind", "other"), ["k1", "k2", "step"]).where((F.col("s0") <= F.col("end") + step) & (F.col("e0") >= F.col("start") - step))

    def has(*kinds: str) -> Column:
        return F.max(F.col("other").isin([KINDS.index(k) for k in kinds]))

    roles = met.groupBy("k1", "k2", "start", "kind", "end").agg(has("access", "login").alias("ident"), has("assign", "hex", "token").alias("secret"), has("endpoint").alias("place"))
    kind = lambda k: F.col("kind") == KINDS.index(k)
    full = roles.where((kind("token") & F.col("ident")) | (kind("login") & F.col("secret") & F.col("place")) | (kind("endpoint") & F.col("ident") & F.col("secret")))
    linked = full.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    out = light.join(linked, ["k1", "k2"], "left")
    return out.select(F.col("_id").alias(id_col), "k1", "k2", *BASE, F.coalesce("linked", none).alias("linked"))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of scan()'s rows."""
    return found.select(
        id_col,
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_listed(F.concat(*BASE)), 256).alias("base_sha256"),
        _listed(F.concat(*BASE, "linked")).alias("spans"),
    )
