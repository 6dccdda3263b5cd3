"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong parts (keyword assignments, access identifiers, long hexadecimal runs) are always reported. Weak candidates
(logins, unlabelled 40-character blobs, endpoints) are reported only where a part of another role (identifier, secret,
endpoint) starts within SCOPE code points: an interval join of candidates and parts by document and position bucket.
Parts are aggregated by document, bucket and role before the join, so dense documents don't multiply rows.

Positions count code points. Gaps and matches of the same pattern add up to them, whatever characters a text holds.

Defined cases: null and empty texts have no spans; repeated rows each keep their own row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: The contract's base kinds, in the order that breaks ties. Minimal lengths apply after matching.
BASE = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
WEAK = [
    ("login", r"""\b((?i)user|username|login|account|client_id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    ("blob", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", 0, 40),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8),
]
ROLE = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "id", "login": "id", "endpoint": "endpoint"}
SCOPE = 400
ORDER = [k for k, *_ in BASE + WEAK]


def _spans(text: Column, found: Column, group: Column, pattern: str, kind: str, least: int) -> Column:
    """Structs (start, rank, end, kind) of the matches whose group is long enough."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.transform(found, F.length).alias("own"), F.transform(group, F.length).alias("part"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def step(acc, z):
        start = acc["at"] + z["gap"]
        span = F.struct(start.alias("start"), F.lit(ORDER.index(kind)).alias("rank"), (start + z["own"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + z["own"]).alias("at"), F.when(z["part"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step)
    return F.when(F.size(found) > 0, folded["out"]).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: doc_id, base (array of spans), linked (array of weak spans whose complement is near)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = BASE + WEAK
    found = rows.select("doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p, _, _ in kinds])
    group = lambda k, p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g)) if g else F.col(f"m_{k}")
    each = {k: _spans(F.col("text"), F.col(f"m_{k}"), group(k, p, g), p, k, least) for k, p, g, least in kinds}
    spans = found.select("doc_id", F.array_sort(F.concat(*[each[k] for k, *_ in BASE])).alias("base"), F.array_sort(F.concat(*[each[k] for k, *_ in WEAK])).alias("weak"))
    spans = scratch.save(spans.withColumn("row", F.monotonically_increasing_id()), "spans")

    roles = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    bucket = (F.floor(F.col("s.start") / scope)).cast("int")
    parts = spans.select("row", F.explode(F.concat("base", "weak")).alias("s")).withColumns({"role": roles[F.col("s.kind")], "bucket": bucket})
    near = parts.groupBy("row", "bucket", "role").agg(F.min("s.start").alias("lo"), F.max("s.start").alias("hi"))
    near = near.select(F.col("row").alias("r"), F.col("bucket").alias("b"), F.col("role").alias("other"), "lo", "hi")
    weak = spans.select("row", F.explode("weak").alias("s")).withColumns({"role": roles[F.col("s.kind")], "bucket": bucket})
    asked = weak.withColumn("ask", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])))
    meets = (asked["row"] == near.r) & (asked["ask"] == near.b) & (F.col("role") != F.col("other")) & (F.col("hi") >= F.col("s.start") - scope) & (F.col("lo") <= F.col("s.start") + scope)
    linked = asked.join(near, meets, "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("linked"))
    return spans.join(linked, "row", "left").select("doc_id", "base", F.coalesce("linked", F.array().cast(spans.schema["weak"].dataType)).alias("linked"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(k) for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "linked"))).alias("spans"))


def brute_force(docs: list[tuple[int, str | None]], scope: int = SCOPE) -> list[tuple]:
    """The contract by plain loops, for tests."""
    import hashlib
    import re

    def matches(kinds, t):
        for k, p, g, least in kinds:
            p = p.replace("((?i)", "((?i:").replace("api_?key)", "api_?key))").replace("client_id)", "client_id))") if "(?i)" in p else p
            for m in re.finditer(p.replace(r"\b", r"(?<![A-Za-z0-9_])"), t):
                if len(m[g]) >= least:
                    yield m.start(), ORDER.index(k), m.end(), k

    out = []
    for d, t in docs:
        t = t or ""
        base, weak = sorted(matches(BASE, t)), sorted(matches(WEAK, t))
        every = base + weak
        linked = [w for w in weak if any(ROLE[o[3]] != ROLE[w[3]] and abs(o[0] - w[0]) <= scope for o in every)]
        said = lambda xs: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(xs))
        out.append((d, *(sum(x[3] == k for x in base) for k, *_ in BASE), hashlib.sha256(said(base).encode()).hexdigest(), said(base + linked)))
    return out
