"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped context.

Seeds are the spans that the fixed patterns find. Their neighbouring words, however far, form lexical patterns. Tokens
with a digit or an at sign outside the seeds are candidates. Spark scores the graph of patterns and
instances in turn: a pattern's confidence is the mean score of its distinct instances; an instance's score is the
noisy-or of the confidences of its patterns (1 for seeds). After ROUNDS rounds, candidates in the context of a pattern
with enough distinct instances and confidence are reported under kind "context".

Counts cover every document; only aggregates are joined, so a common pattern costs no task more than its share.

Positions count code points. Defined cases: null and empty texts have no spans; repeated rows, and rows with a null id,
each keep their own; the work on a text of any length is linear but for the look-up of neighbours; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 4, 0.75
KINDS = ["email", "ip", "card", "phone", "context"]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD_CHARS = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(t: str):
    """Each @ once: back over the local part as far as the last match allows, then the domain. Linear in the text."""
    done, at = 0, t.find("@")
    while at >= 0:
        first = at
        while first > done and t[first - 1] in _LOCAL_CHARS:
            first -= 1
        m = _DOMAIN.match(t, at + 1) if first < at else None
        done = m.end() if m else at + 1
        if m:
            yield first, done
        at = t.find("@", done)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(t)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in t:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(c.isdecimal() for c in m[0]) <= 15]
    out.sort()
    return out


def _key(s: str) -> str:
    """A value or word, lower-cased, to be compared by; long ones by a hash of 128 bits."""
    s = s.lower()
    return s if len(s) <= 64 else hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=16).hexdigest()


class Words:
    """Runs of letters and digits of a text, found in one pass; neighbours are looked up in it."""

    def __init__(self, t: str):
        self.text, runs = t, [m.span() for m in _WORD_CHARS.finditer(t)]
        self.starts, self.ends = [a for a, _ in runs], [b for _, b in runs]

    def around(self, a: int, b: int) -> tuple[str, str]:
        """The word before and the word after a span, however far; a run that the span cuts counts with its outer part."""
        i, j = bisect_left(self.starts, a) - 1, bisect_right(self.ends, b)
        left = self.text[self.starts[i] : min(a, self.ends[i])] if i >= 0 else ""
        right = self.text[max(b, self.starts[j]) : self.ends[j]] if j < len(self.ends) else ""
        return _key(left), _key(right)


def _candidates(t: str, taken: list[tuple[int, int, int]]):
    """Identifier-shaped tokens that overlap no seed."""
    k, done = 0, 0
    spans = sorted((a, b) for a, _, b in taken)
    for m in _MARK.finditer(t):
        if m.start() < done:
            continue
        a, b = m.span()
        while a > done and (t[a - 1].isalnum() or t[a - 1] in "-_/@"):
            a -= 1
        while b < len(t) and (t[b].isalnum() or t[b] in "-_/@"):
            b += 1
        done = b
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if k == len(spans) or spans[k][0] >= b:
            yield a, b


SPAN = "struct<start:int,rank:int,end:int>"
FOUND = f"doc_id long, base array<{SPAN}>, seen array<struct<start:int,end:int,seed:boolean,value:string,left:string,right:string>>"


def _find(batches):
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            base, seen = [], []
            for t in b.column(1).slice(lo, 512).to_pylist():
                t = t or ""
                spans = base_spans(t)
                base.append([{"start": a, "rank": k, "end": e} for a, k, e in spans])
                both = [(a, e, True) for a, _, e in spans] + [(a, e, False) for a, e in _candidates(t, spans)]
                words = Words(t) if both else None
                seen.append([{"start": a, "end": e, "seed": s, "value": _key(t[a:e]), **dict(zip(("left", "right"), words.around(a, e)))} for a, e, s in both])
            kinds = (pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("value", pa.string()), ("left", pa.string()), ("right", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), pa.array(base, kinds[0]), pa.array(seen, kinds[1])], ["doc_id", "base", "seen"])


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Per row: doc_id, base and context spans (start, rank in KINDS, end)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_find, FOUND)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    seen = rows.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    # a pattern: the word before, the word after, or both
    patterns = F.array(F.when(F.col("left") != "", F.concat(F.lit("l "), "left")), F.when(F.col("right") != "", F.concat(F.lit("r "), "right")), F.concat_ws(" ", F.lit("b"), "left", "right"))
    linked = seen.withColumn("pattern", F.explode(patterns)).where("pattern is not null")
    graph = scratch.save(linked.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    score = graph.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        trust = graph.join(score, "value").groupBy("pattern").agg(F.avg("score").alias("trust"), F.count("*").alias("support"), F.count_if("seed").alias("seeds")).where((F.col("support") >= min_support) & (F.col("seeds") >= 2))
        trust = scratch.save(trust, "trust")
        raised = graph.join(trust, "pattern", "left").groupBy("value").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("trust", F.lit(0.0)), F.lit(0.999)))))).alias("any"))
        score = scratch.save(raised.select("value", F.when(F.col("seed"), 1.0).otherwise(F.when(F.col("any") >= min_confidence, F.col("any")).otherwise(0.0)).alias("score")), "score")
    sure = trust.where(F.col("trust") >= min_confidence).select("pattern")
    new = linked.where("not seed").join(sure, "pattern", "left_semi")
    new = new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(KINDS.index("context")).alias("rank"), "end"))).alias("context"))
    return rows.select("row", "doc_id", "base").join(new, "row", "left").select("doc_id", "base", F.coalesce("context", F.array().cast(f"array<{SPAN}>")).alias("context"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[of_kind(k) for k in range(4)], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "context"))).alias("spans"))


def brute_force_base(t: str | None) -> list[tuple[int, int, int]]:
    """The contract's patterns as they stand, for tests."""
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)
